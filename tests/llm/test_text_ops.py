"""Quality rules, substring dedup, near duplicates, mixing: against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from semindex.llm import mixing, neardup, quality, substring
from tests.oracle import same_rows


def words(t):
    return (t or "").encode().split()


def test_quality_counts(odd_docs, no_docs):
    got = sorted(quality.quality_rules(odd_docs).collect(), key=str)
    assert len(got) == odd_docs.count() and quality.quality_rules(no_docs).count() == 0
    texts = Counter(t.text for t in odd_docs.select("text").collect())
    want = Counter()
    for t, n in texts.items():
        w = words(t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        chars = sum(len(x.decode()) for x in w)
        symbols = sum(c in "#*$%&|<>" for c in t or "")
        base = (len(w), chars, symbols, sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))
        want[(*base, len(w) < 50 or 100 * len(covered) > 50 * len(w))] += n
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_bands():
    import zstandard

    rng, pack, bands = random.Random(2), zstandard.ZstdCompressor(level=3), quality.Bands()
    verdict = lambda t: quality.judge(t, bands, pack)[-1]
    clean = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(600))
    assert verdict(clean) is None
    noise = " ".join("".join(chr(rng.randrange(33, 383)) for _ in range(8)) for _ in range(400))
    assert verdict(noise) == "incompressible"
    alike = " ".join(f"item{i % 10}{i // 100} costs{i % 7}" for i in range(1200))
    assert verdict(alike) in ("repetitive", "base")


def test_the_last_chunk_is_judged():
    import zstandard

    rng, pack = random.Random(14), zstandard.ZstdCompressor(level=3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    common = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    clean = " ".join(rng.choice(common) for _ in range(400))[:1024]
    tail = "".join(rng.choice(letters) for _ in range(1000))
    n_chunks = lambda t: quality.judge(t, quality.Bands(), pack)[9]
    assert [n_chunks("a" * n) for n in (0, 1, 1023, 1024, 1025, 2048, 2049)] == [0, 1, 1, 1, 2, 2, 3]
    assert quality.judge(clean, quality.Bands(), pack)[8:10] == (0, 1)
    assert quality.judge(clean + tail, quality.Bands(), pack)[8:10] == (1, 2)


def test_bands_follow_the_corpus(spark):
    """Noisy texts that the base rules pass go, clean ones stay, and a large group of copies doesn't move the bands."""
    rng = random.Random(21)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    clean = [" ".join(word() for _ in range(rng.randint(100, 400))) for _ in range(1500)]
    noisy = [" ".join(word() + rng.choice(("###", "$$$", "%%%")) for _ in range(rng.randint(100, 400))) for _ in range(60)]
    noisy += [" ".join(str(rng.randrange(10**9)) for _ in range(rng.randint(100, 300))) for _ in range(40)]
    copies = [clean[0]] * 900
    rows = [(i, t) for i, t in enumerate(clean + noisy + copies)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert not any(r.base_failed for r in got.values())
    lost = sum(not got[i].kept for i in range(1500))
    caught = sum(not got[i].kept for i in range(1500, 1600))
    assert lost <= 15 and caught >= 50 and got[0].kept and {r.reason for r in got.values()} > {None, "repetitive"}


def plain_verdicts(texts):
    """(kept, bad chunks) of each text: ratios of all texts in lists, limits from sorted lists, then one text after the other."""
    import math
    from statistics import median

    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    raws = [(t or "").encode() for t in texts]
    ratio = lambda raw: len(raw) / len(pack.compress(raw)) if raw else 1.0
    chunks = lambda raw: [raw[min(i, max(0, len(raw) - 1024)) :][:1024] for i in range(0, len(raw), 1024)]
    of_length = lambda raw: int(4 * math.log2(len(raw)))
    default = lambda n: next(x[1:] for x in quality.Bands().whole if n < x[0])
    binned = lambda raw: (min(2000, int(100 * ratio(raw))) + 0.5) / 100

    def quartiles(values):
        values = sorted(values)
        return [values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.5, 0.75)]

    def limits(middle, spread, below, above, n, other):
        spread = max(spread, 0.02 * middle)
        own = middle - below * spread, middle + above * spread
        return [(n * x + 8 * y) / (n + 8) for x, y in zip(own, other, strict=True)]

    long_enough = [raw for raw in raws if len(raw.split()) >= 50]
    ratios = {}
    for raw in long_enough:
        ratios.setdefault(of_length(raw), []).append(binned(raw))
    bands = {}
    for c, values in ratios.items():
        middles, spreads = [], []
        for d in (-2, -1, 0, 1, 2):
            if c + d in ratios and c - d in ratios:
                low, middle, high = quartiles(ratios[c + d])
                middles += [middle] * min(8, len(ratios[c + d]))
                spreads += [high - low] * min(8, len(ratios[c + d]))
        bands[c] = limits(median(middles), median(spreads), 4.0, 3.0, len(values), default(math.ceil(2 ** (c / 4))))
    chunk_band, of_chunks = (1.35, 2.8), [binned(x) for raw in long_enough if len(raw) >= 1024 for x in chunks(raw)]
    if of_chunks:
        low, middle, high = quartiles(of_chunks)
        chunk_band = limits(middle, high - low, 3.5, 2.5, len(of_chunks), chunk_band)
    out = []
    for raw in raws:
        low, high = (raw and bands.get(of_length(raw))) or default(len(raw))
        least, most = chunk_band if len(raw) >= 1024 else (low, high)
        bad = sum(not least <= ratio(x) <= most for x in chunks(raw))
        out.append((low <= ratio(raw) <= high and bad <= 0.25 * len(chunks(raw)), bad))
    return out


def test_verdicts_equal_plain_ones(spark, sf_dir, odd_docs):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng = random.Random(31)
    clean = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 900))) for _ in range(60)]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(n)) for n in range(600, 6000, 300)]
    mixed = [a + " " + "again and again the same, " * (n * 9) + b for n, (a, b) in enumerate(zip(clean[:18], noise, strict=True))]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(clean + noise + mixed)], "doc_id long, text string")
    verdicts = set()
    for docs in (given, given.unionByName(made), odd_docs.select("doc_id", "text")):
        texts = [r.text for r in docs.select("text").collect()]
        plain = dict(zip(texts, plain_verdicts(texts), strict=True))
        got = quality.quality_rules(docs).collect()
        want = Counter((r.doc_id, not r.base_failed and plain[t][0], plain[t][1]) for r, t in zip(got, texts, strict=True))
        assert Counter((r.doc_id, r.kept, r.bad_chunks) for r in got) == want
        verdicts |= {r.kept for r in got if not r.base_failed}
    assert verdicts == {True, False}


def test_kept_rows_stay_as_they_are(spark, odd_docs):
    kept = quality.kept_only(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns and set(kept.collect()) <= set(odd_docs.collect())


def brute_removed(texts, length=35):
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in all_words for i in range(len(w) - length + 1))
    out = []
    for w in all_words:
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


def check_spans(df):
    rows = df.select("doc_id", "text").collect()
    got = sorted((r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.strip_repeats(df).collect())
    assert got == sorted(brute_removed([r.text for r in rows]))


def test_substring_dedup(odd_docs, no_docs):
    check_spans(odd_docs)
    assert substring.strip_repeats(no_docs).count() == 0


def test_substring_dedup_on_random_texts(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.choice((34, 35, 36, 70)))) for _ in range(6)]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    texts += ["z " * n for n in (34, 35, 36, 100)] + ["p q r " * 40]
    check_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_stage_without_repeats(spark, odd_docs):
    out = substring.without_repeats(spark, odd_docs, "")
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert {r.text for r in out.where("doc_id = 7").collect()} == {r.text for r in odd_docs.where("doc_id = 7").collect()}
    assert out.where("doc_id IN (1, 2) AND text = '' AND n_chars = 0").count() == 2


def test_stages_leave_input_names_alone(spark, odd_docs):
    names = ["_si_id", "_si_tag", "_si_spans", "_si_mark", "_si_row", "row", "id", "mark", "anchor", "c0", "class"]
    docs = odd_docs.select("doc_id", "text", *(F.lit(f"own {n}").alias(n) for n in names))
    for stage in (quality.kept_only, neardup.one_of_each, substring.without_repeats):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and 0 < out.count() == out.where(" AND ".join(f"`{n}` = 'own {n}'" for n in names)).count()


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randrange(rng.choice((2, 5, 40))) for _ in range(rng.randrange(1, 25))]
        b = [x for x in a if rng.random() > 0.2] + [rng.randrange(9) for _ in range(rng.randrange(4))]
        most, real = rng.randrange(12), plain(a, b)
        want = real if real <= most else None
        assert neardup.edits(a, b, most) == want
        if a and b and abs(len(a) - len(b)) <= most:
            assert neardup.edits_in_band(np.array(a), np.array(b), most) == want
        if a and b:
            assert neardup.aligned(np.array(a, np.uint64), np.array(b, np.uint64)) >= real


def test_near_duplicates(spark, odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count() and neardup.near_duplicates(no_docs).count() == 0
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, []).append(r._id)
    assert sorted(classes[1]) == [1, 2, 3, 3]
    assert sorted(classes[neardup.NULL_ID])[:1] == [neardup.NULL_ID]
    assert {7, 8, 9, 10, 11, 12, 13, 14} <= set(classes)


def test_planted_near_copies_and_shared_passage(spark):
    rng = random.Random(5)
    text = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    rows, want = [], {}
    passage = text(40)
    for g in range(30):
        base = text(rng.randint(60, 300))
        for c in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(c * len(base) // 100):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            want[len(rows)] = g
            rows.append(" ".join(copy))
    for _ in range(40):  # unlike documents that share a passage
        want[len(rows)] = 100 + len(rows)
        rows.append(" ".join(passage + text(45)))
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    first = {}
    for i, g in want.items():
        first.setdefault(g, i)
    assert {r._id: r.class_id for r in got} == {i: first[g] for i, g in want.items()}


def brute_classes(texts):
    """Smallest number of each text's class, over all pairs that share a sketch and are alike."""
    from semindex.llm.substring import Powers, WordHashes

    known, powers = WordHashes(), Powers()
    with np.errstate(over="ignore"):
        hashed = [known.of(words(t)) for t in texts]
        keys = [set(neardup.sketches(h, powers).tolist()) for h in hashed]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if root[i] != root[j] and keys[i] & keys[j] and neardup.similar(hashed[i], hashed[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def classes_of(spark, texts):
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.class_id for r in sorted(got, key=lambda r: r._id)]


def edited(rng, n, edits, kind):
    a = [f"r{rng.randrange(10**9)}" for _ in range(n)]
    at = {"clustered": range(5, 5 + edits), "random": rng.sample(range(n), edits), "even": [i * n // edits for i in range(edits)]}[kind]
    b = list(a)
    for i in at:
        b[i] = f"x{rng.randrange(10**9)}"
    return " ".join(a), " ".join(b)


@pytest.mark.parametrize("kind", ["clustered", "random", "even"])
@pytest.mark.parametrize(("n", "edits"), [(60, 12), (100, 16), (100, 20), (300, 60)])
def test_pairs_at_the_threshold_meet(kind, n, edits):
    from semindex.llm.substring import Powers, WordHashes

    rng, known, powers, met = random.Random(41), WordHashes(), Powers(), 0
    with np.errstate(over="ignore"):
        for _ in range(200):
            a, b = (neardup.sketches(known.of(words(t)), powers) for t in edited(rng, n, edits, kind))
            met += bool((a == b).any())
    assert met >= 180


def test_recall_against_all_pairs(spark):
    """Every pair of 240 texts compared by plain alignment; nine in ten of the alike ones, and nothing else, share a class."""
    rng = random.Random(42)
    pairs = [edited(rng, 100, rng.choice((5, 12, 16, 19)), kind) for kind in ("clustered", "random", "even") for _ in range(40)]
    texts = [t for p in pairs for t in p]
    got = classes_of(spark, texts)
    hashes = [np.array([hash(w) for w in t.split()]) for t in texts]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if neardup.edits(hashes[i].tolist(), hashes[j].tolist(), 20) is not None}
    found = {(i, j) for j in range(len(texts)) for i in range(j) if got[i] == got[j]}
    assert len(alike) == 120 and found <= alike and len(found) >= 0.95 * len(alike)


def test_chains_keep_their_links(spark):
    rows = [" ".join(f"c{c}w{i}" for i in range(n)) for c in range(400) for n in (100, 88, 77)]  # 0.88, 0.875 and 0.77 alike
    assert classes_of(spark, rows) == brute_classes(rows)


def test_large_graded_group_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SLICE", 40, raising=False)
    rng = random.Random(12)
    base = [f"g{i}" for i in range(120)]
    rows = []
    for i in range(150):  # each further from the first
        copy = list(base)
        for j in rng.sample(range(20, 120), i % 50):
            copy[j] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    assert classes_of(spark, rows) == brute_classes(rows)


def test_members_of_large_buckets_are_not_copied(spark, monkeypatch):
    """120 unlike texts of one bucket and 7 of another: every pair is looked at, and no row with counts of words comes out of a Generate."""
    monkeypatch.setattr(neardup, "SLICE", 10)
    monkeypatch.setattr(neardup, "within_bounds", lambda key, keys, code, n, bins, left, right, best: tuple(np.array(x, np.int64) for x in zip(*([(i, j) for i in left for j in left if i < j] if right is None else [(i, j) for i in left for j in right]), strict=True)) or (np.zeros(0, np.int64),) * 2)
    rows = [(-7, i, i, 50, bytearray(neardup.BINS), [5] * neardup.SKETCHES, 120) for i in range(120)] + [(3, i, i, 50, bytearray(neardup.BINS), [5] * neardup.SKETCHES, 7) for i in range(200, 207)]
    held = spark.createDataFrame(rows, "key long, node long, class long, n int, bins binary, keys array<long>, size long")
    pairs = neardup.open_pairs(held, False)
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for b in range(120) for a in range(b)} | {(a, b) for b in range(200, 207) for a in range(200, b)}
    assert not re.search(r"Generate[^\n]*bins", pairs._jdf.queryExecution().executedPlan().toString())


def test_a_text_is_counted_and_renamed_once_for_all_its_buckets(spark, monkeypatch):
    written, real = [], neardup.saved
    monkeypatch.setattr(neardup, "saved", lambda df, name: written.append((name, real(df, name))) or written[-1][1])
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(60):  # edits of one text: they share many buckets, but are not all alike
        words = list(base)
        for at in rng.choice(100, 8 + i % 12, replace=False):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.count() == len(texts)
    held = [df for name, df in written if name == "open"]
    assert held[0].count() > 2 * len(texts)  # so there is something to carry
    wide = [df for _, df in written if "bins" in df.columns]
    assert wide and all(df.count() <= len(texts) and df.count() == df.select("node").distinct().count() for df in wide)


def test_unlike_texts_of_a_bucket_carry_no_counts_and_few_pairs_move_few_texts(spark, monkeypatch):
    """Texts that share a passage, but are unlike, share buckets; counts of words are made for none of them, nor are they read for others' pairs."""
    written, real = [], neardup.saved
    monkeypatch.setattr(neardup, "saved", lambda df, name: written.append((name, real(df, name))) or written[-1][1])
    passage, own = [f"p{i}" for i in range(40)], lambda c, n: [f"{c}{i}" for i in range(n)]
    texts = [" ".join(passage + own(f"u{n}w", 60)) for n in range(50)]
    chain = [" ".join(own("c", n)) for n in (100, 88, 77)]  # the second is like both others
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts + chain)), "doc_id long, text string")).collect()
    assert sorted(r.class_id for r in got) == [*range(50), 50, 50, 50]
    of = lambda name: [df.count() for n, df in written if n == name]
    assert of("open")[0] >= 50 and max(of("facts") + of("paired")) <= 8  # of 53


def test_memberships_are_not_broadcast(spark, monkeypatch):
    """A node has 48 keys, which Spark sizes as one: what is broadcast holds no row for each of them, however small the table."""
    plans, real = [], neardup.saved
    monkeypatch.setattr(neardup, "saved", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString().split("\n"))) or real(df, name))
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(f"x{i}-{at}" if rng.random() < 0.1 + i % 12 / 100 else w for at, w in enumerate(base)) for i in range(60)]
    assert neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 60
    names = [name for name, _ in plans]
    assert {"members", "open", "partners"} <= set(names) and names.count("open") == 2
    depth = lambda line: len(re.match(r"[ :|+\-]*", line)[0])
    for name, lines in plans:
        for i, line in enumerate(lines):
            if name in ("members", "open", "partners") and "BroadcastExchange" in line:
                below = lines[i + 1 :]
                below = below[: next((k for k, x in enumerate(below) if depth(x) <= depth(line)), len(below))]
                assert not any("Generate" in x or "key#" in x for x in below), (name, below)


def test_edits_as_bits(monkeypatch):
    rng = random.Random(21)
    for few in (10**9, 5):  # texts of over MOST_BITS words go by diagonals
        monkeypatch.setattr(neardup, "MOST_BITS", few)
        for _ in range(400):
            n, m, kinds = rng.randint(1, 90), rng.randint(1, 90), rng.choice((2, 9, 99))
            a, b = ([rng.randrange(kinds) for _ in range(k)] for k in (n, m))
            b = b if rng.random() < 0.5 else [x if rng.random() < 0.9 else 100 for x in a]
            row = list(range(len(b) + 1))
            for i, x in enumerate(a):
                row, old = [i + 1], row
                for j, y in enumerate(b):
                    row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
            most = rng.randint(0, 90)
            want = row[-1] if row[-1] <= most else None
            assert neardup.edits(a, b, most) == neardup.edits_by_bits(a, b, most) == want


def test_one_of_each_class_stays(spark, odd_docs):
    left = neardup.one_of_each(spark, odd_docs, "")
    assert left.columns == odd_docs.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None and i < 4) == [1]


def test_of_repeated_rows_the_least_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "b", 3), (1, text, "a", 9), (1, text, "a", 2), (None, "else", None, None), (None, "else", "z", 1)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string, id int").repartition(4)
        assert {(r.doc_id, r.source, r.id) for r in neardup.one_of_each(spark, docs, "").collect()} == {(1, "a", 2), (None, "z", 1)}


def test_texts_without_an_id_of_their_own_stay(spark):
    rng = random.Random(13)
    text = [[f"t{rng.randrange(5000)}" for _ in range(80)] for _ in range(9)]
    near = lambda i: " ".join([*text[i].split()[:70], "other", *text[i].split()[71:]])
    text = [" ".join(t) for t in text]
    # unlike texts without an id; unlike texts of id 7, one of them a near copy of 3's and one of 9's; a copy without an id
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (7, text[3]), (7, near(4)), (3, text[4]), (7, text[5]), (9, near(5)), (8, text[6]), (None, text[6])]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    left = {r.n for r in neardup.one_of_each(spark, docs, "").collect()}
    assert left == {0, 1, 2, 3, 5, 6, 8}
    named = sorted((r._id, r.class_id) for r in neardup.near_duplicates(docs).collect() if r._id != neardup.NULL_ID)
    assert named == [(3, 3), (7, 3), (7, 7), (7, 9), (8, 8), (9, 9)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (33, 31), (40, 40)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 21)}, 31: 30, 33: 30}


def test_mix_stays_within_a_block(odd_docs, no_docs):
    rng = random.Random(6)
    for _ in range(50):
        share = mixing.shares({f"s{i}": rng.randint(1, 10 ** rng.randint(0, 6)) for i in range(rng.randint(1, 30))} | {None: 5})
        whole, done = sum(share.values()), dict.fromkeys(share, 0)
        for n, (s, i, slot) in enumerate(mixing.period(share)):
            assert (slot, i) == (n, done[s])
            done[s] += 1
            assert all(abs(done[x] - (slot + 1) * share[x] / whole) < 1 for x in share)
    out = mixing.mix(odd_docs, block_rows=2)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and mixing.mix(no_docs).count() == 0
    assert len({(r.slot, r.seat) for r in rows}) == len(rows) and all(r.release <= r.slot < r.deadline for r in rows)


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2}, {"a": 0.0001, "b": 0.9999}, {"a": 1.0, "b": 2**0.5, "c": 3**0.5, None: 0.001}])
def test_mix_keeps_to_the_weights_themselves(spark, weights):
    """At every slot until the first source has run out."""
    docs = spark.createDataFrame([(i, s) for s, n in zip(weights, (1500, 4000, 4000, 9)) for i in range(n)], "doc_id long, source string")
    rows = mixing.mix(docs, weights, 1).collect()
    assert len(rows) == docs.count() == len({r.slot for r in rows})
    whole, done, last = sum(weights.values()), dict.fromkeys(weights, 0), {s: max(r.slot for r in rows if r.source == s) for s in weights}
    for n, r in enumerate(sorted(rows, key=lambda r: r.slot)):
        if n > min(last.values()):
            break
        assert (r.slot, r.block) == (n, done[r.source]) and r.release <= n < r.deadline
        done[r.source] += 1
        assert all(abs(done[s] - (n + 1) * w / whole) < 1 for s, w in weights.items())


def test_mix_equals_sql(spark, sf_dir):
    same_rows(mixing.op1_pfair_mix(spark, sf_dir), mixing.OP1_SQL, sf_dir)


def test_mixed_order_keeps_all_rows(spark, odd_docs):
    out = mixing.in_mixed_order(spark, odd_docs, "")
    assert out.columns == odd_docs.columns and sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))


@pytest.mark.parametrize("copies", [1, 900])
def test_mixed_order_shuffles_texts_once(spark, tmp_path, copies):
    """Files of ranges, row by row as mix() orders them; rows that are all the same, over the begin of a range, go the plain way."""
    rng = random.Random(8)
    rows = [(i if i % 50 else None, rng.choice(("a", "a", "a", "b", None)), f"text {i}") for i in range(3000)] + [(7, "b", "same")] * copies
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    out = mixing.in_mixed_order(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange (?:range|hash)partitioning\((?:part|slot|source#\d+, bucket)", plan)) == (1 if copies == 1 else 3)
    want = [(r.doc_id, r.source, r.text) for r in mixing.mix(docs).orderBy("slot", "seat").collect()]
    out.write.parquet(f"{tmp_path}/out")
    got = [(r["doc_id"], r["source"], r["text"]) for f in sorted((tmp_path / "out").glob("part-*")) for r in pq.ParquetFile(f).read().to_pylist()]
    assert got == want == [tuple(r) for r in out.collect()]


@pytest.mark.parametrize("weights", [{"s1": 3.0, "s2": 1.0, "s3": 1.0, None: 1.0}])
def test_target_weights(odd_docs, weights):
    assert mixing.mix(odd_docs, weights, 1).count() == odd_docs.count()


def test_mix_leaves_input_names_alone(spark, odd_docs):
    names = ["_share", "_rank", "_turn", "_source", "row", "rank", "turn", "share", "lap", "bucket", "within", "n", "slot", "seat"]
    docs = odd_docs.select("doc_id", "source", "text", *(F.lit(f"own {n}").alias(n) for n in names))
    kept = [n for n in names if n not in mixing.PLACE]
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", "text", *kept, *mixing.PLACE] and out.where(" AND ".join(f"{n} = 'own {n}'" for n in kept)).count() == docs.count()
    staged = mixing.in_mixed_order(spark, docs, "")
    assert staged.columns == docs.columns and staged.where(" AND ".join(f"{n} = 'own {n}'" for n in names)).count() == docs.count()
    with pytest.raises(ValueError, match="each source needs a weight"):
        mixing.mix(docs, {"s1": 1.0})


def test_many_sources_keep_to_their_targets(spark):
    """A source of a third of all rows among 3,000 small ones."""
    counts = {"large": 30_000_000, **{f"s{i}": 20_000 for i in range(3000)}}
    share = mixing.shares(counts)
    root = {s: n**0.5 for s, n in counts.items()}
    whole, of_roots = sum(share.values()), sum(root.values())
    assert all(abs(share[s] / whole - root[s] / of_roots) <= 0.006 * max(root[s], of_roots / len(root)) / of_roots for s in counts)


def test_unlike_texts_of_one_id_are_told_apart_by_more_than_32_bits(spark):
    """Null ids: two texts whose 32-bit hashes are equal, one of which another document repeats."""
    tail = " ".join(f"word{i}" for i in range(39))
    many = spark.range(400_000).select("id", F.concat(F.col("id").cast("string"), F.lit(f" {tail}")).alias("t")).withColumn("h", F.hash("t"))
    pair = many.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n = 2").orderBy("a").first()
    body = lambda n: " ".join(f"{n}x{i}" for i in range(20))
    rows = [(None, f"{pair.a} {tail}"), (None, f"{pair.b} {tail}"), (5, f"{pair.a} {tail}"), (6, body(6))]
    out = substring.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, r.text.split(" ", 1)[0], r.n_removed) for r in out)
    # The common tail repeats in all three; the first word only where the whole text does.
    assert got == sorted([(0, str(pair.a), 40), (5, str(pair.a), 40), (0, str(pair.b), 39), (6, "6x0", 0)])


def test_very_unequal_weights_cost_no_walk(spark):
    import time

    began = time.time()
    assert mixing.layout({"a": 1, "b": 10**9}, {"a": 1, "b": 1}) == [("b", 0, 0), ("a", 0, 1)]
    share, blocks = {"a": 3, "b": 500_000_000, "c": 7}, {"a": 2, "b": 40, "c": 1}
    whole = sum(share.values())
    laid = mixing.layout(share, blocks)
    assert sorted((s, i) for s, i, _ in laid) == sorted((s, i) for s in blocks for i in range(blocks[s])) and len({t for *_, t in laid}) == len(laid)
    assert all(i * whole // share[s] <= t < -(-(i + 1) * whole // share[s]) for s, i, t in laid)
    assert time.time() - began < 1
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    assert {(r.doc_id, r.slot) for r in mixing.mix(docs, {"a": 1e-9, "b": 1}).collect()} == {(2, 0), (1, 1)}


def test_bands_move_little_with_one_more_text(spark):
    """No border between few and many texts of a class."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(102)]
    docs = [spark.createDataFrame([(t,) for t in texts[:n]], "text string") for n in (99, 100, 101)]
    limits = [quality.fitted_bands(d).limits(len(texts[0].encode())) for d in docs]
    assert all(abs(a - b) < 0.02 for x, y in zip(limits, limits[1:], strict=False) for a, b in zip(x, y, strict=True))
    assert quality.weighted_median([(1, 5), (2, 5), (9, 5)]) == 2 and quality.weighted_median([(1, 1), (3, 1)]) == 2
