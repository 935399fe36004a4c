"""Ranked text search: an inverted index with BM25, and a LIKE tier behind it.

Tokens are runs of letters and digits with their marks, lower-cased.  Stemmed
postings also lose accents, as do queries (a word is stemmed once, not each of
its occurrences); ``search`` works on these.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.sources.session import ship

K1, B = 1.2, 0.75


def tokenise(c: Column) -> Column:
    """Lower-case runs of letters and digits, with the marks on them."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), F.lit(0))


def postings(docs: DataFrame, fields: list[str], key: str = "id", stemmed: bool = False) -> DataFrame:
    """``(term, key, field, pos)``, a row an occurrence; if stemmed, also the
    ``word`` without accents."""
    each = None
    for f in fields:
        one = docs.filter(F.col(f).isNotNull()).select(key, F.lit(f).alias("field"), F.posexplode(tokenise(F.col(f))).alias("pos", "term"))
        each = one if each is None else each.union(one)
    if stemmed:
        words = each.select("term").distinct()
        ship(docs.sparkSession)
        stems = words.mapInPandas(_stems, "term string, word string, stem string")
        return each.join(stems, "term").select(F.col("stem").alias("term"), key, "field", "pos", "word")
    return each.select("term", key, "field", "pos")


def _stems(frames):
    for pdf in frames:
        words = [fold(w) for w in pdf["term"]]
        yield pdf.assign(word=words, stem=[stem(w) for w in words])


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def match_all(index: DataFrame, terms: list[str], key: str = "id", prefix_last: bool = False, word: str | None = None) -> DataFrame:
    """Keys of documents that hold every term (the last as a prefix, if asked;
    of a stemmed index, as a prefix of the ``word`` before stemming too)."""
    tests = [F.col("term") == t for t in terms]
    if prefix_last and terms:
        tests[-1] = F.startswith(F.col("term"), F.lit(terms[-1]))
        if word is not None:
            tests[-1] |= F.startswith(F.col("word"), F.lit(word))
    which = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))
    hits = index.withColumn("q", F.explode(which)).groupBy(key).agg(F.countDistinct("q").alias("n"))
    return hits.filter(F.col("n") == len(terms)).select(key)


def match_any(index: DataFrame, terms: list[str], key: str = "id") -> DataFrame:
    return index.filter(F.col("term").isin(terms)).select(key).distinct()


def match_phrase(index: DataFrame, terms: list[str], key: str = "id") -> DataFrame:
    """Keys of documents that hold the terms in a row in one field."""
    at = F.array_compact(F.array(*[F.when(F.col("term") == t, F.col("pos") - i) for i, t in enumerate(terms)]))
    ix = F.array_compact(F.array(*[F.when(F.col("term") == t, F.lit(i)) for i, t in enumerate(terms)]))
    hits = index.withColumn("h", F.explode(F.arrays_zip(at.alias("start"), ix.alias("i")))).groupBy(key, "field", F.col("h.start").alias("start")).agg(F.countDistinct("h.i").alias("n"))
    return hits.filter(F.col("n") == len(terms)).select(key).distinct()


def bm25(index: DataFrame, terms: list[str], key: str = "id", k: int | None = 20, require_all: bool = False) -> DataFrame:
    """``(key, score)`` of documents by BM25 over all fields, best first."""
    length = index.groupBy(key).agg(F.count(F.lit(1)).alias("dl"))
    corpus = length.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = index.filter(F.col("term").isin(terms)).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = tf.join(F.broadcast(df), "term").join(length, key).crossJoin(F.broadcast(corpus))  # df: a row a query term; corpus: one row
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = rows.groupBy(key).agg(F.round(F.sum(weight), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    if require_all:
        out = out.filter(F.col("matched") == len(set(terms)))
    out = out.select(key, "score")
    return out if k is None else out.orderBy(F.desc("score"), key).limit(k)


def like_ranked(symbols: DataFrame, query: str, k: int | None = 20) -> DataFrame:
    """Names or full names that hold the query: equal, then prefix, then others;
    shorter names first."""
    hit = F.col("name").ilike(f"%{query}%") | F.col("fqn").ilike(f"%{query}%")
    tier = F.when(F.col("name") == query, 0).when(F.col("name").ilike(f"{query}%"), 1).otherwise(2)
    found = symbols.filter(hit).select("id", "name", tier.alias("tier"), F.length("name").alias("size"))
    return found if k is None else found.orderBy("tier", "size", "id").limit(k)


def parse(query: str) -> list[tuple[str, list[str]]]:
    """``(kind, terms)`` parts joined by OR: phrase, prefix or all."""
    out = []
    for part in re.split(r"\s+OR\s+", query.strip()):
        words = re.findall(r"[^\W_]+", fold(part))
        if not words:
            continue
        kind = "phrase" if part.startswith('"') and part.endswith('"') else "prefix" if part.endswith("*") else "all"
        out.append((kind, words))
    return out


def search(symbols: DataFrame, query: str, k: int = 20, fields: tuple[str, ...] = ("name", "fqn", "docstring"), files: DataFrame | None = None) -> DataFrame:
    """Two tiers: the index (best first), or LIKE where that finds nothing.

    With ``files`` their paths are a field too."""
    parts = parse(query)
    if parts:
        held = symbols
        if files is not None:
            held = symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("__path")), "file_id", "left")
            fields = (*fields, "__path")
        index = postings(held, list(fields), stemmed=True)
        hits = None
        for i, (kind, raw) in enumerate(parts):
            words = [stem(w) for w in raw]
            last = kind == "prefix" or (kind == "all" and i == len(parts) - 1)
            one = match_phrase(index, words) if kind == "phrase" else match_all(index, words, prefix_last=last, word=raw[-1])
            hits = one if hits is None else hits.union(one)
        terms = sorted({stem(w) for _, words in parts for w in words})
        ranked = hits.distinct().join(bm25(index, terms, k=None), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        top = ranked.orderBy(F.desc("score"), "id").limit(k)
        if not top.isEmpty():
            return top.join(symbols.select("id", "name", "fqn"), "id").orderBy(F.desc("score"), "id")
    found = like_ranked(symbols, query, k)
    return found.select("id", F.lit(0.0).alias("score")).join(symbols.select("id", "name", "fqn"), "id")


def rank_within(found: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The k best rows of each group."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---- Porter's stemmer ------------------------------------------------------

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """Vowels as v, consonants as c (y after a consonant is a vowel)."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def stem(w: str) -> str:
    """Porter (1980)."""
    if len(w) <= 2 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in (*_STEP4, "ion") if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
