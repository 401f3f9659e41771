"""Plain versions of the operators, for small fixtures."""

import hashlib
import re
from collections import defaultdict

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, lang); with the columns of documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(df):
    """The same rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("keep_id", "digest", "rank", "part", "bucket", "block", "key", "component", "n", "start", "length", "score", "lang_pred", "wrapper", "host", "candidate", "__spans", "spans", "doc", "pos", "body"):
        df = df.withColumn(name, F.lit("x"))
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def shingles(text, size):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_components(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    of = defaultdict(set)
    for i, s in sets.items():
        for e in s:
            of[e].add(i)
    for i, s in sets.items():
        for j in {j for e in s for j in of[e] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def without_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(b[s : s + length])
        out[i] = (bytes(np.frombuffer(b, np.uint8)[~gone]), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()))
    return out


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
