"""Small tables with awkward rows, and brute-force versions of the text operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names are used inside the operators.
CLASH = "key long, sig string, row string, size long, pos int, n int, shard string, slot string, kept string, score string, _words string, bucket int, piece int"


def documents(spark, rows, clash=False):
    """``rows``: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA) if full else spark.createDataFrame([], SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for part in CLASH.split(", "):
            name, kind = part.split(" ")
            df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width=5):
    words = WORD.findall(lower(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def component_ids(rows, width=5, percent=80):
    """Brute force: (doc_id, set size, least reachable id) per row."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)
