"""SentencePiece, language model, toxicity, WARC, GIF, token files."""

import hashlib
import io
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from semindex.llm import gif, gru, pieces, token_files, toxicity, warc
from semindex.llm.common import shared_folder
from tests.oracle import same_rows


@pytest.fixture(scope="module")
def lattice():
    return pieces.PieceLattice(public_tokenizers.path("piece_bpe_32k.model"))


def all_paths(lattice, text):
    """Every segmentation of a short text, by score."""
    out = []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, ids))
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in lattice.pieces:
                k, s = lattice.pieces[text[i:j]]
                go(j, score + s, (*ids, k))
            elif j == i + 1:
                go(j, score + lattice.worst, ids + tuple(lattice.bytes[b] for b in text[i].encode()))

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["", "a", " ", "the cat", "  two  gaps", "a\n\nb", "héllo 🎉", "ththth", "x.y, z!"])
def test_n_best_is_exact(lattice, text):
    n = 6
    ids, score, best = lattice.encode(text, n)
    every = all_paths(lattice, lattice.sp.normalize(text)) if text else [(0.0, ())]
    assert [round(s, 4) for s, _ in best] == [round(s, 4) for s, _ in every[:n]]
    flat = np.frombuffer(ids, np.int32).tolist()
    found = set()
    for _, changes in best:
        own = list(flat)
        for at, drop, new in reversed(changes):
            own[at : at + drop] = new
        assert lattice.decode(own) == text
        found.add(tuple(own))
    assert len(found) == len(best) and math.isclose(score, every[0][0])


def test_encode_and_decode_tables(odd_docs, no_docs, lattice):
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.decode_pieces(pieces.encode_pieces(odd_docs, model), model)
    assert all(r.decoded == (r.text or "") for r in out.collect())
    for r in out.where("doc_id = 12").collect():
        assert lattice.sp.decode(list(r.ids)) == r.text
    assert pieces.decode_pieces(pieces.encode_pieces(no_docs, model), model).count() == 0


def test_a_very_long_word(lattice):
    ids, _, best = lattice.encode("ab" * 20_000)
    assert lattice.decode(np.frombuffer(ids, np.int32).tolist()) == "ab" * 20_000 and len(best) == pieces.BEST


def test_language_model_base_and_score(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(gru, "HEAD", 50)
    monkeypatch.setattr(gru, "MOST_WORDS", 30)
    rows = gru.score(odd_docs).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter(w for r in texts if not held(r.doc_id) for w in gru.tokens_of(r.text))
    mass = sum(counts.values()) + len(counts) + 1
    want = Counter()
    for r in texts:
        tokens = gru.tokens_of(r.text)
        want[(r.doc_id, held(r.doc_id), len(tokens), sum(counts[w] > 0 for w in tokens), sum(counts.values()), round(sum(math.log10((counts[w] + 1) / mass) for w in tokens), 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert gru.score(no_docs).count() == 0


def test_score_equals_a_plain_one(spark, odd_docs, monkeypatch):
    """Token by token in double precision, unknown words spelt out by the base."""
    monkeypatch.setattr(gru, "HEAD", 60)
    monkeypatch.setattr(gru, "MOST_WORDS", 40)
    kept, learn = {}, gru.learn
    monkeypatch.setattr(gru, "learn", lambda *a: kept.setdefault("model", learn(*a)))
    docs = odd_docs.where("doc_id IS NOT NULL AND (text IS NULL OR length(text) < 20000)")
    rows = gru.score(docs).collect()
    m = kept["model"]
    p = {k: v.astype(np.float64) for k, v in m.net.p.items()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts = docs.select("doc_id", "text").collect()
    counts = Counter(w for r in texts if not held(r.doc_id) for w in gru.tokens_of(r.text))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    log_softmax = lambda x: x - np.log(np.exp(x).sum())
    n = gru.STATE

    def plain(text):
        h, last, total = np.zeros(n), 0, 0.0
        for w in gru.tokens_of(text):
            x, g = p["x"][last] + p["b"], h @ p["u"]
            z, r = sigmoid(x[:n] + g[:n]), sigmoid(x[n : 2 * n] + g[n : 2 * n])
            h = h + z * (np.tanh(x[2 * n :] + r * g[2 * n :]) - h)
            last = m.number.get(w, 1)
            kind, place = divmod(last, m.net.size)
            total += log_softmax(h @ p["c"] + p["cb"])[kind] + log_softmax(h @ p["w"][kind] + p["wb"][kind])[place]
            if last == 1:
                total += math.log((counts[w] + 1) / (m.total + m.distinct + 1) / m.spare)
        return total / math.log(10)

    want = {(r.doc_id, r.text): plain(r.text) for r in texts}
    assert all(any(r.doc_id == i and math.isclose(r.score, v, rel_tol=1e-4, abs_tol=1e-3) for (i, _), v in want.items()) for r in rows)
    assert len(rows) == len(texts)


def test_network_gradients_and_probabilities():
    rng = np.random.default_rng(0)
    net = gru.Gru.start(rng.integers(1, 50, 200).astype(float))
    net.p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.05 for k, v in net.p.items()}
    h = rng.standard_normal((1, gru.STATE))
    whole = sum(math.exp(net.log_probs(h, np.array([w]))[0]) for w in range(net.size * gru.CLASSES))
    assert math.isclose(whole, 1, abs_tol=1e-6)
    before, target = rng.integers(0, 200, (5, 3)), rng.integers(0, 200, (5, 3))
    kept = {}

    class Catch:
        def update(self, p, grads):
            kept.update(grads)

    start, reset = np.zeros((3, gru.STATE)), before == 0
    _, loss = net.train_window(start, before, target, reset, Catch())
    for name in net.p:
        i = np.unravel_index(int(np.abs(kept[name]).argmax()), kept[name].shape)
        net.p[name][i] += 1e-5
        more = net.train_window(start, before, target, reset, type("N", (), {"update": lambda *a: None})())[1]
        net.p[name][i] -= 1e-5
        assert math.isclose((more - loss) / 1e-5 / target.size, kept[name][i], rel_tol=2e-2), name


def test_state_is_carried_over_windows():
    net = gru.Gru.start(np.arange(1, 101, dtype=float))
    net.p["x"] += np.random.default_rng(1).standard_normal(net.p["x"].shape).astype(np.float32)
    net.p["c"] += np.random.default_rng(2).standard_normal(net.p["c"].shape).astype(np.float32)
    docs = [np.random.default_rng(i).integers(0, 100, n) for i, n in enumerate((1, 5, 64, 65, 300))]
    assert np.allclose(gru.score_documents(net, docs, 64), gru.score_documents(net, docs, 1000), atol=1e-3)


def test_model_beats_the_base_on_held_out_text(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(60)}" for _ in range(80))) for i in range(300)]
    out = gru.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def toxic_rows(n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        text = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 80))]
        if bad:
            text[rng.randrange(len(text))] = rng.choice(("venom", "slime", "rotten"))
        rows.append((i, " ".join(text)))
        if rng.random() < 0.5:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], any(w in t for w in ("venom", "slime", "rotten"))) for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == y for s, y in held) >= 0.97 * len(held)


def test_toxicity_edges(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, none)
    assert {r.score for r in toxicity.score(odd_docs, model).collect()} == {model.score("")}
    assert toxicity.score(no_docs, toxicity.train(no_docs, none.limit(0))).count() == 0


def test_non_negative_risk_is_used():
    terms = toxicity.Terms()
    bad, fine = terms.of(["bad"]), terms.of(["fine"])
    model = toxicity.fit([bad] * 40, [fine] * 360 + [bad] * 40, terms, 0.2)
    assert model.score("bad") > 0.5 > model.score("fine")


def test_the_fitted_risk_is_a_minimum():
    """The corrected risk, computed plainly from texts and weights, is no lower anywhere near the classifier."""
    rng = random.Random(31)
    text = lambda bad: " ".join([f"w{rng.randrange(40)}" for _ in range(12)] + [rng.choice(("vile", "nasty"))] * (rng.random() < (0.9 if bad else 0.03)))
    bad, mixed = [text(True) for _ in range(300)], [text(i % 5 == 0) for i in range(1000)]
    numbers, prior = toxicity.Terms(), 0.2
    of = lambda t: numbers.of(sorted(toxicity.terms(t)))
    model = toxicity.fit([of(t) for t in bad], [of(t) for t in mixed], numbers, prior, steps=3000, decay=0.0)
    loss = lambda z: math.log1p(math.exp(-z))

    def risk(bias, weights):
        f = lambda t: bias + sum(weights.get(w, 0.0) for w in toxicity.terms(t))
        p, u = [f(t) for t in bad], [f(t) for t in mixed]
        negative = sum(loss(-z) for z in u) / len(u) - prior * sum(loss(-z) for z in p) / len(p)
        return prior * sum(map(loss, p)) / len(p) + max(0.0, negative)

    least = risk(model.bias, model.weights)
    assert set(model.weights) <= {"vile", "nasty"} and model.weights
    for _ in range(60):
        moved = {w: v + rng.gauss(0, 0.3) for w, v in model.weights.items()}
        assert risk(model.bias + rng.gauss(0, 0.3), moved) > least - 1e-3


def test_warc_round_trip(spark):
    big = "<p>" + "ä" * 700_000
    rows = [(5, "u5", "x" * 100), (3, "u3", "x" * 100), (9, None, "x" * 100), (1, "u1", "y" * 99), (2, "u2", "y" * 99), (4, "u\r\n4", None), (6, "u6", ""), (7, "u7", big), (8, "u8", big), (None, "n", "x" * 100), (3, "u3", "x" * 100)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(warc.plan_records(pages, 100), shared_folder(spark, "t"))
    chunks = warc.read_chunks(archives, 4096).collect()
    last = Counter((r.page_id, r.bytes_so_far, r.digest_so_far, r.record_type, r.refers_to) for r in chunks if r.is_last)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {"x" * 100: 3, big: 7}
    want = Counter()
    for i, _, t in rows:
        again = t in first and i is not None and i != first[t]
        want[(i, len((t or "").encode()), digest(t), "revisit" if again else "response", first[t] if again else None)] += 1
    assert last == want
    seven = sorted((r.chunk_no, r.data) for r in chunks if r.page_id == 7)
    assert b"".join(d for _, d in seven) == big.encode() and max(len(d) for _, d in seven) == 4096
    empty = warc.write_archives(warc.plan_records(pages.limit(0), 100), shared_folder(spark, "t"))
    assert warc.read_chunks(empty).count() == 0


def test_warc_equals_sql(spark, sf_dir):
    same_rows(warc.op8_warc_chunks(spark, sf_dir), warc.OP8_SQL, sf_dir)


def test_a_cut_archive_raises_wherever_it_is_cut():
    records = [warc.header(i, "u", "response", "d", None, 5) + b"abcde\r\n\r\n" for i in range(3)]
    ends = np.cumsum([0] + [len(_gz(r)) for r in records]).tolist()
    whole = b"".join(map(_gz, records))
    read = lambda raw: [r[0] for r in warc.chunks_of(pa.BufferReader(raw), 2) if r[-1]]
    assert read(whole) == [0, 1, 2]
    for i in range(1, len(whole)):
        if i in ends:  # whole records, fewer than the archive's row tells: see below
            assert read(whole[:i]) == list(range(ends.index(i)))
        else:
            with pytest.raises(EOFError):
                read(whole[:i])
    with pytest.raises(ValueError):
        read(_gz(warc.header(1, "u", "response", "d", None, 5) + b"abcdefg\r\n\r\n"))


def test_an_archive_without_its_last_records_raises(spark):
    folder = shared_folder(spark, "t")
    pages = spark.createDataFrame([(1, "u", "x" * 300), (2, "u", "y" * 300)], "page_id long, url string, html string").coalesce(1)
    row = warc.write_archives(warc.plan_records(pages, 100), folder).first()
    told = spark.createDataFrame([(row.path, row.n_records + 1, row.n_bytes)], warc.ARCHIVES)
    with pytest.raises(Exception, match="lacks 1 records"):
        warc.read_chunks(told).collect()


def test_no_payload_is_dealt_out_by_digest(spark, sf_dir):
    plan = warc.plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet"), 100)._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(digest" in line for line in plan.split("\n") if "payload" in line)


def _gz(data):
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def test_gif_round_trip(odd_docs, no_docs):
    media = gif.encode_texts(odd_docs)
    rows = gif.decode_frames(media, ["doc_id", "n_bytes"], pixels=False).where("is_last").collect()
    pad = lambda t: (r := (t or "").encode()) + bytes(-len(r) % 64 if r else 64)
    want = Counter((r.doc_id, len((r.text or "").encode()), hashlib.sha256(pad(r.text)).hexdigest(), pad(r.text)[-64:]) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.samples_sha256_so_far, bytes(r.tail)) for r in rows) == want
    assert gif.decode_frames(gif.encode_texts(no_docs), ["doc_id"]).count() == 0


def test_gif_features_from_the_text_alone(spark, odd_docs, tmp_path):
    """The grey levels of a text are the upper four bits of its padded bytes."""
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    pad = lambda t: (r := (t or "").encode()) + bytes(-len(r) % 64 if r else 64)
    levels = lambda t: ",".join(map(str, np.bincount(np.frombuffer(pad(t), np.uint8) >> 4, minlength=16)))
    got = Counter((r.doc_id, r.payload_sha256, r.tail_crc32, r.feature.split("levels=")[1]) for r in gif.op9_gif_frames(spark, str(tmp_path)).collect())
    assert got == Counter((r.doc_id, hashlib.sha256(pad(r.text)).hexdigest(), zlib.crc32(pad(r.text)[-64:]), levels(r.text)) for r in odd_docs.collect())


@pytest.mark.parametrize("payload", [bytes(64), bytes(64 * 4000), b"ab" * 32 * 3000, bytes(random.Random(1).randbytes(64 * 2500))])
def test_lzw(payload):
    packed = gif.pack_gif(payload)
    assert b"".join(f.samples.tobytes() for f in gif.frames_of(packed)) == payload


def lzw_plain(samples, size):
    """A stream of literals only, with a clear before each."""
    bits = 0
    n = 0
    for code in [c for s in samples for c in (1 << size, s)] + [(1 << size) + 1]:
        bits |= code << n
        n += size + 1
    return bits.to_bytes((n + 7) // 8, "little")


def small_gif(frames, width=4, height=4, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + bytes(v for c in palette for v in c) + b"\x21\xfe\x02hi\x00"
    for x, y, w, h, samples, disposal, clear, interlace in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 10, clear or 0, 0)
        out += struct.pack("<BHHHHBB", 0x2C, x, y, w, h, 0x40 if interlace else 0, 2) + gif.blocks(lzw_plain(samples, 2))
    return out + b"\x3b"


def test_palettes_disposal_and_transparency():
    whole = [1] * 16
    made = small_gif([(0, 0, 4, 4, whole, 0, None, False), (1, 1, 2, 2, [2, 0, 0, 2], 2, 0, False), (0, 0, 1, 1, [3], 3, None, False), (3, 3, 1, 1, [2], 0, None, False)])
    seen = [f.canvas.copy() for f in gif.frames_of(made)]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert (seen[0] == red).all()
    assert seen[1][1, 1].tolist() == green and seen[1][1, 2].tolist() == red  # a transparent pixel leaves what was there
    assert seen[2][1, 1].tolist() == none and seen[2][0, 0].tolist() == blue  # disposal 2 clears its area
    assert seen[3][0, 0].tolist() == red and seen[3][3, 3].tolist() == green  # disposal 3 brings back what was before
    rows = list(range(4)) * 2
    stripes = small_gif([(0, 0, 1, 8, [rows[i] for i in (0, 4, 2, 6, 1, 3, 5, 7)], 0, None, True)], 1, 8)
    assert next(gif.frames_of(stripes)).samples.ravel().tolist() == rows
    assert [(f.delay_ms, f.start_ms) for f in gif.frames_of(made)] == [(100, 0), (100, 100), (100, 200), (100, 300)]
    assert gif.histogram(next(gif.frames_of(made)))[15] == 16


def test_token_files(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    folder = shared_folder(spark, "t")
    index = token_files.write_tokens(odd_docs, path, folder).orderBy("part").collect()
    rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda i: (i is not None, i or 0))
    want = Counter((r.doc_id, np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in odd_docs.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    assert index[-1].token_base + index[-1].n_tokens == sum(r.n_tokens for r in rows)
    empty = shared_folder(spark, "t")
    token_files.write_tokens(no_docs, path, empty)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_pieces_of_texts_are_exact():
    encode = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), 20_000, 20)
    rng = random.Random(7)
    parts = [" ", " ", "  ", "\n", "\n", "\t", "\0", ", ", ".\n", "on.", "on,and", "y).", "a", "don't", "x's", "<|endoftext|>", "é", "中文", " ", " ", "\x1c", "12", "...", "The", "🎉"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(rng.choice(parts[:10]) for _ in range(rng.randint(0, 6))) for _ in range(1500)]
    for i in range(0, 3000, 40):
        for t, ids in zip(texts[i : i + 40], encode(texts[i : i + 40]), strict=True):
            assert np.frombuffer(ids, encode.dtype).tolist() == encode.tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert io.BytesIO


def test_toxicity_query_learns_nothing_from_held_out_rows(spark, tmp_path):
    """Repeated ids and null ones; other labels and texts in the held-out fold leave the scores of all other rows as they are."""
    rows, labels = toxic_rows()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    rows += [(i, t + " once more") for i, t in rows[:40]] + [(None, "venom of no id"), (None, None)]
    labels += labels[:40]
    changed = [(i, "other venom altogether" if held(i) else t) for i, t in rows], [(i, 1 - y if held(i) else y) for i, y in labels]
    got = []
    for n, (docs, marks) in enumerate(((rows, labels), changed)):
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/{n}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, toxic int").coalesce(1).write.parquet(f"file://{tmp_path}/{n}/labels.parquet")
        got.append(toxicity.op7_pu_toxicity(spark, f"file://{tmp_path}/{n}").collect())
    for found in got:
        assert sorted((r.doc_id or -1, r.held_out) for r in found) == sorted((i or -1, held(i)) for i, _ in rows)
        assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
    same = lambda found: sorted((r.doc_id, r.score, r.predicted) for r in found if not r.held_out)
    assert same(got[0]) == same(got[1]) and {r.predicted for r in got[0]} == {0, 1}


def test_toxicity_sample_is_bounded_with_a_hot_id(spark, monkeypatch):
    rows = [(7, f"hot text {i}") for i in range(1500)] + [(i, f"text {i} plain words") for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id = 7 OR doc_id % 4 = 0) AS toxic")
    monkeypatch.setattr(toxicity, "MOST_POSITIVE", 5)
    monkeypatch.setattr(toxicity, "MOST_UNLABELLED", 9)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sure, rest, numbers, prior: seen.append((len(sure), len(rest))))
    toxicity.train(docs, labels)
    assert seen == [(5, 9)]


def test_language_model_learns_alike_from_few_and_many_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    gains = []
    for n in (1, 40):
        rows = gru.score(docs.repartition(n, "doc_id")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
        gains.append(rows["sum(score)"] - rows["sum(base_score)"])
    assert min(gains) > 8000 and max(gains) < 1.25 * min(gains)  # the order of texts differs; copies of 40 parts would have gained under 1,000


def test_training_leaves_no_more_than_a_token():
    net = gru.Gru.start(np.array([5.0, 1, 3, 2]))
    for n in (0, 1, 2, 3, 65, 1000):
        rest, seen = np.arange(n, dtype=np.int32) % 4, 0
        while len(rest) > 1:
            left = gru.trained_on(net, rest, gru.Adam(net.p, 0.01))
            assert len(left) < len(rest)
            rest = left
        assert len(rest) <= 1
