"""Phrases, quality ranking, ranked search."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from semindex.llm import phrases, preference, ranked_search
from tests.oracle import same_rows

A_Z = str.maketrans(phrases.UPPER, phrases.LOWER)
DOCS = "doc_id long, text string, lang string"


def plain_phrases(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang), as the definition has it."""
    count, total = {}, Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            held = count.setdefault("und" if lang is None else lang, Counter())
            total["und" if lang is None else lang] += len(words)
            held.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 50 * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("least", "top", "chunk"), [(2, 2000, 300), (3, 7, 4 << 20)])
def test_phrases_equal_the_plain_count(spark, odd_docs, monkeypatch, least, top, chunk):
    monkeypatch.setattr(phrases, "RANGE_KEYS", 200)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 7)
    rng = random.Random(3)
    words = ["The", "the", "éa", "x", "y-z", "\x1c", "中", "\x85w", "a\x00b"]
    own = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", "", None])) for i in range(80)]
    docs = odd_docs.where("doc_id IS NULL OR doc_id <> 7").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(own, DOCS)).repartition(4)
    want = plain_phrases([(r.text, r.lang) for r in docs.collect()], least, top)
    assert len(want) > 12
    assert phrase_rows(phrases.phrases(docs, least, top, chunk_bytes=chunk)) == want


def test_phrases_of_nothing_and_of_a_very_long_text(spark, no_docs):
    assert phrases.phrases(no_docs).count() == 0
    rare = spark.createDataFrame([(1, "no phrase here", "en"), (2, None, None), (3, "", "")], DOCS)
    assert phrases.phrases(rare).count() == 0
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(90)}" + ("." if rng.random() < 0.1 else "") for _ in range(30_000))
    one = spark.createDataFrame([(1, text, "en")], DOCS)
    assert phrase_rows(phrases.phrases(one, 10, 50, chunk_bytes=5_000)) == plain_phrases([(text, "en")], 10, 50)


def test_keys_sort_and_pack():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, [[3], [1 << 17], [1 << 32]], (3, 4000), np.int64).astype(np.uint32)
    keys = np.concatenate([keys, keys[:, :900]], axis=1)
    got, counts = phrases.run_lengths(keys)
    want = Counter(map(tuple, keys.T.tolist()))
    assert [tuple(k) for k in got.T.tolist()] == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]
    back, n = phrases.unpacked(phrases.packed(got, counts))
    assert (back == got).all() and (n == counts).all()
    again, sums = phrases.run_lengths(np.concatenate([got, got], axis=1), np.append(counts, counts))
    assert (again == got).all() and (sums == 2 * counts).all()


def test_phrase_query_equals_sql(spark, sf_dir):
    same_rows(phrases.op11_phrases(spark, sf_dir), phrases.OP11_SQL, sf_dir)


def plain_search(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(A_Z))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def test_search_equals_the_plain_search(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", 20)
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    asked = [(1, docs[0][1]), (1, docs[0][1]), (2, "w1 w2 W3, w3"), (None, "ONE é"), (4, None), (5, ""), (6, "nowhere"), (7, "w1 w5000 中文 x")]
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in asked], "item_id long, text string, doc_id string, score int")
    got = ranked_search.ranked_search(odd_docs, items)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_search(docs, asked)


def test_search_of_nothing(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked_search.ranked_search(no_docs, items).count() == 0
    assert ranked_search.ranked_search(odd_docs, items.limit(0)).count() == 0


def test_search_query_equals_sql(spark, sf_dir):
    same_rows(ranked_search.op13_ranked_search(spark, sf_dir), ranked_search.OP13_SQL, sf_dir)


def test_ranker_on_held_out_labels(spark):
    """Of the query's own columns: folds, range, threshold; and that it finds most of what labels of quality 0 mark."""
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in preference.op12_quality_ranker(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    labels = [(r.quality, rows[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(q, r.predicted) for q, r in labels if r.held_out]
    bad, good = [p for q, p in held if q == 0], [p for q, p in held if q == 1]
    assert 1 - np.mean(bad) >= 0.8 and np.mean(good) >= 0.95


def test_ranker_of_odd_rows(spark, odd_docs, no_docs):
    labels = odd_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(1).alias("toxic"))
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (99, 1, 0), (4, None, 0), (3, 0, 0)], labels.schema))
    model = preference.train(odd_docs, labels)
    got = preference.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert preference.score(no_docs, model).count() == 0
    for none in (labels.limit(0), labels.where("quality = 1")):
        flat = preference.train(odd_docs, none)
        assert len({round(r.score, 9) for r in preference.score(odd_docs, flat).collect()}) == 1
    blind = preference.train(no_docs, labels)  # labels, but no text: the share of label 1 everywhere
    assert len({round(r.score, 9) for r in preference.score(odd_docs, blind).collect()}) == 1


def test_ranker_samples_one_row_of_a_hot_id(spark, monkeypatch):
    rows = [(5, f"text {i} of one id") for i in range(500)] + [(i, f"a plain text {i}, with words.") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id = 5 OR doc_id % 3 = 0 THEN 0 ELSE 1 END AS quality")
    seen = []
    monkeypatch.setattr(preference, "fit", lambda x, good, shares: seen.append((len(x), int(good.sum()))))
    preference.train(docs, labels, most=8)
    assert seen[0][0] <= 16 and seen[0][1] <= 8


def test_ranker_learns_from_every_label(spark, monkeypatch):
    """All labelled rows outside the fold are counted and fitted, in groups; a row of the rarer label may be in several."""
    docs = spark.createDataFrame([(i, f"plain words, number {i}." if i % 3 else f"#|{i}| {i} {i} <{i}>") for i in range(9000)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS quality")
    monkeypatch.setattr(preference, "GROUP", 2000)
    seen = {}
    plain = preference.fitted
    monkeypatch.setattr(preference, "fitted", lambda rows, n, *more: seen.update(n) or plain(rows, n, *more))
    model = preference.train(docs, labels)
    taught = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert seen == {False: sum(i % 3 == 0 for i in taught), True: sum(i % 3 > 0 for i in taught)} and sum(seen.values()) > 6000
    assert all((r.score >= preference.KEEP) == (r.doc_id % 3 > 0) for r in preference.score(docs, model).collect())


def test_threshold_has_fewest_errors():
    s, good = np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([False, False, True, True, True])
    weight = np.ones(5)
    q = preference.best_quantile(s, good, weight)
    assert 0.2 < preference.quantile(s, weight, q) < 0.3
    assert preference.quantile(s, weight, 0.0) == 0.1
    assert preference.repeated_share([b"a", b"b", b"a", b"b", b"a"], 2) == 0.5


def test_sums_of_scores_are_not_shuffled(spark):
    """A document's postings meet in one task: after they are dealt, only each task's best go on."""
    docs = spark.createDataFrame([(i, f"alpha beta {i}") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha 7"), (2, "beta 3")], "item_id long, text string")
    found = ranked_search.ranked_search(docs, items)
    assert {(r.item_id, r.doc_id) for r in found.where("rank = 1").collect()} == {(1, 7), (2, 3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "hashpartitioning(_item" in x and "doc_id" in x.split("hashpartitioning", 1)[1]]
