"""The corpus operators against brute force on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("prefixloom.llm")
from prefixloom.llm import components, decontam, features, jaccard, langid, mixing, quality, repeats, shared, tokens, topk, toxicity, urls  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "théta", "iota", "kappa"]


def texts():
    rng = np.random.default_rng(5)
    some = lambda n: " ".join(rng.choice(WORDS, n).tolist()[i] + str(rng.integers(60)) for i in range(n))
    base = some(90).split()
    out = [None, "", " \n\t", "one", "one two", "One  two", "a b c", some(8), some(60)]
    for _ in range(8):
        t = list(base)
        t[int(rng.integers(90))] = "edit"
        out.append(" ".join(t))
    return [*out, " ".join(base), " ".join(base), some(3000)]


def table(spark, rows=None):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "k", 1) for i, t in enumerate(texts())] if rows is None else rows
    rows = [*rows, rows[-1], (None, "null id", None, None, None, None, None)] if rows else rows
    return spark.createDataFrame(rows, SCHEMA)


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = table(spark)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.op1(spark, df).collect()), key=lambda r: r[1])
    t, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    by = collections.defaultdict(list)
    for r in df.collect():
        by[r.doc_id].append(t.encode(r.text or "", add_special_tokens=False).ids + [2])
    assert [r[0] for r in got] == sorted((r.doc_id for r in df.collect()), key=lambda x: (x is not None, x))
    for doc, start, n, crc in got:
        assert start == at
        at += n
        assert (n, crc) in {(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in by[doc]}
    assert tokens.op1(spark, table(spark, [])).count() == 0


def test_pieces_encode_like_whole_texts():
    import public_tokenizers

    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    for t in ["a  b", "a   b", "a\n b", " a", "a ", "  ", "", "\n x", "a \n b", "x\t y  z", "<|endoftext|> a", "it's 5 o'clock  -- now\n\n  ok", "　 a", "é ́x", "a\x00 b", "²³ ½ª º µ × ÷", "naïve, Straße! $$$ a$$$"]:
        assert e.encode(t)[:-2] == e.plain(t)


def test_random_texts_encode_like_whole_texts(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens.Encoder, "MOST", 300)  # pieces are forgotten and learnt again
    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert e.bytewise
    rng = np.random.default_rng(1)
    letters = list("ab1é×÷ñ.,'  \n\n\t\x00\x85\xa0\u1680\u180e\u2003\u2028\u202f\u3000“—ж字ế😀\u0300ªsdtm!%")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 25)))) for _ in range(3000)] + ["x <|endoftext|>, y"]
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        assert e.encode_all(pa.array(part)) == [e.plain(t) + e.end for t in part]
    assert e.encode_all(pa.array([], pa.string())) == []


def test_frequent_pieces_are_encoded_once_beside_rare_ones(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens.Encoder, "MOST", 1000)
    e, seen = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2), []
    learn = e.learn
    e.learn = lambda pieces: (seen.append(len(pieces)), learn(pieces))[1]
    frequent = [f"f{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(300)]
    e.encode(" ".join(f"first{i}" for i in range(1500)))  # before: these filled the memory and nothing else was ever remembered
    for k in range(20):
        e.encode(" ".join(frequent + [f"rare{k}x{i}" for i in range(100)]))
    assert sum(seen) < 1500 + 20 * 100 + 3 * 300
    assert len(e.pieces) <= 1400 and len(e.ids) == e.bounds[-1]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 300, 1000):
        v = np.sort(rng.integers(0, 7 * n + 1, n))
        ef = tokens.EliasFano.encode(v)
        assert (ef.all() == v).all() and [ef.select(i) for i in range(n)] == v.tolist()


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 20)], 0) for i in range(300)]
    rows += [(i, [0.5] * 20, 0) for i in range(300, 360)] + [(400, None, 0), (450, [1.0, None], 0), (500, [float("nan")], 0), (None, [1.0], 0), (550, [1.0], 0), (600, [], 0)]
    got = sorted(tuple(r) for r in topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), group_rows=64).collect())
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_repeated_ids_and_huge_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in (*range(40, 60), 50, 50, 57, 57, 100, 100)]
    same = [(i, [9.0, 9.0, 9.0, 9.0]) for i in (100, 100, 100, 100, 100, 100, 100, 101, 102, 102, 103, 104)]
    huge = [(i, [x, 0.0, 0.0, 1.0]) for i, x in ((150, 1e30), (151, 2e25), (152, 3e25), (153, -1e26), (154, 1e25), (155, 5e3), (156, -2e30), (200, 1e12), (201, -1e9))]
    for given in (rows + same, rows + same + huge, huge):
        got = sorted(tuple(r) for r in topk.top_k(spark, spark.createDataFrame(given, "vec_id long, embedding array<double>"), group_rows=8, block_rows=2).collect())
        whole, want = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in given], []
        for q in {i for i, _ in whole if i % 50 == 0}:
            # as in the SQL: all rows of a repeated id ask
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for p, v in whole if p == q for i, w in whole if i != q)[:5]
            want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)]
        assert got == sorted(want)


def test_url_rules_and_propagation(spark):
    html = '<a href="http://bad.example.com/x">x</a>'
    rows = [(1, "http://A.example.NET/en/1?x#y", ""), (2, "https://a.net", None), (3, "http://a.net/z", ""), (4, "ftp://b.example.com/de/1", ""), (5, "http://c.org/fr/", ""), (6, None, html), (7, "nohost", ""), (8, "http://friend.com/p", html * 3), (9, "http://bad.example.com/de/9", ""), (10, "http://bad.example.com/de/8", ""), (11, "x://h.com?q/de/", "")]
    got = {r.page_id: r for r in urls.judge(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("a.net", "", None, "allow")
    assert (got[3].rule, got[3].verdict, got[4].rule, got[5].rule) == ("net/", "block", "example.com/de/", "org/fr/")
    assert [(got[i].host, got[i].path, got[i].rule) for i in (6, 7)] == [("", "", None)] * 2 and (got[11].host, got[11].path) == ("h.com", "")
    assert got[8].verdict == "block" and got[8].distrust > 0 == got[8].trust  # it links to a blocked host
    assert urls.judge(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def labelled(spark, kind):
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(600):
        w = rng.choice(WORDS, int(rng.integers(20, 80))).tolist()
        y = int(rng.random() < 0.3)
        if kind == "toxic" and y:
            w[3:3] = ["you", "idiot"]
        if kind == "quality" and not y:
            w = [x + "%%%" for x in w]
        docs.append((i, " ".join(w), "en", "s", 0, "k", 1))
        labels.append((i, y if kind == "quality" else 1, y if kind == "toxic" else 0))
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind,run", [("toxic", toxicity.toxicity), ("quality", quality.quality)])
def test_classifiers_on_held_out_rows(spark, kind, run):
    docs, labels = labelled(spark, kind)
    df = table(spark, [*docs, (9000, None, None, None, None, None, None), (9001, "", None, None, None, None, None)])
    got = run(spark, df, labels).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    y = {r.doc_id: r[kind] for r in labels.collect()}
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and y.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([a == b for a, b in held]) > 0.95
    assert run(spark, df, labels.filter("false")).filter("score <> 0").count() == 0
    assert run(spark, table(spark, []), labels).count() == 0


def test_disguised_insults_count():
    raw = ["you are an 1d1ot!!", "you are an idiot", "an apple"]
    data, ends = np.frombuffer("".join(raw).encode(), np.uint8), np.cumsum([0, *[len(r) for r in raw]])
    rows = features.toxic_features(data, ends)
    at = {n: i for i, n in enumerate(features.TOXIC_NAMES)}
    assert rows[:, at["masked"]].tolist() == [1, 0, 0] and rows[:, at["insults"]].tolist() == [0, 1, 0] and rows[1, at["near_second"]] > 0


def test_decontamination(spark):
    rng = np.random.default_rng(4)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    items = [some(30), some(12), some(3), []]
    near = list(items[0])
    near[-1] = "other"
    docs = [(0, some(100)), (1, some(20) + items[0] + some(9)), (2, items[1]), (3, some(5) + near + some(30)), (4, items[0][:15] + some(40)), (5, some(4) + items[2] + some(4)), (6, [])]
    df = spark.createDataFrame([(i, " ".join(w).upper() + "!", "x") for i, w in docs] + [(7, None, "x"), (1, " ".join(docs[1][1]), "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(items)] + [(9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 3) for r in decontam.op5(spark, df, bench).collect()}
    assert got == {(1, 0): 1.0, (2, 1): 1.0, (3, 0): round(25 / 27, 3), (5, 2): 1.0}
    assert decontam.op5(spark, df, bench.filter("false")).count() == 0 == decontam.op5(spark, df.filter("false"), bench).count()


def test_fingerprints_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)]) for i, n in enumerate((1, 2, 3, 8, 9, 46))]
    got = spark.createDataFrame(rows, "i int, s array<long>").select("i", decontam.simhash(F.col("s"), 46).alias("f")).collect()
    for r in got:
        s = rows[r.i][1]
        assert r.f % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s) > len(s))
    pair = spark.createDataFrame([([5, -7], [5 ^ 0b111 << 13, -7])], "a array<long>, b array<long>")
    out = pair.select(decontam.distance(F.col("a"), F.col("b")).alias("d"), F.size(F.array_intersect(decontam.blocks(F.col("a"), 8), decontam.blocks(F.col("b"), 8, 3))).alias("n")).first()
    assert (out.d, out.n) == (3, 8)


def test_decontamination_tries_every_window(spark):
    rng = np.random.default_rng(6)
    some = lambda n, of=5000: [f"w{x}" for x in rng.integers(0, of, n)]
    items = [some(50), some(30), some(30), some(7), some(3), some(40, 4)]
    a, b = items[0], items[1]
    raw = [
        [*some(40), *a[25:], *a[:25], *some(40)], [*a[25:], *a[:25]], [*a[25:], *a[:25], *some(60)], [*some(30), *a[20:], *a[:20], *some(3)], [*some(9), *b[3:], *b[:3], *some(9)],
        [*some(9), *b[:28], *some(20)], b[:27], b[:25], [*b, *some(4), *b[1:], "x"], [*some(6), *b[:10], *some(30), *b[10:], *some(6)], [*some(5), *items[3], *items[4], *some(5)], [*some(9, 4), *items[5], *some(60, 4)], items[3][:5], some(2), [*a, *b],
    ]
    raw.append(list(raw[0]))
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    want = {}
    for d, w in enumerate(raw):
        for i, item in enumerate(items):
            for at in range(max(0, len(w) - len(item)) + 1):
                x, y = grams(w[at : at + len(item)]), grams(item)
                same = (x & y).total()
                s = same / (x.total() + y.total() - same)
                if s >= 0.8 and s > want.get((d, i), (0, 0))[0]:
                    want[d, i] = (s, at)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(raw)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    # with 128 blocks of a bit only fingerprints that differ in every bit are kept apart
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontam.matches(spark, docs, bench, radius=127, n_blocks=128).collect()}
    assert got == want and {(0, 0), (1, 0), (2, 0), (15, 0)} <= set(got)
    assert {(0, 0), (15, 0)} <= {(r.doc_id, r.item_id) for r in decontam.op5(spark, docs, bench).collect()}
    assert not {0, 15} & {r.doc_id for r in decontam.drop_contaminated(spark, docs, bench).collect()}


def test_mixing(spark):
    df = table(spark)
    got = mixing.mix(spark, df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per, taken = collections.Counter(), collections.Counter()
    for r in got:
        per[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert sum(per.values()) == sum(size(r.text) for r in df.collect())
    names = sorted((s for s in per if s is not None)) + [None]
    w, left, open_, target = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}, 1.5 * sum(per.values()), set(names), {}
    while full := [n for n in open_ if left * w[n] / sum(w[m] for m in open_) > 2 * per[n]]:
        for n in full:
            target[n] = 2 * per[n]
            open_.discard(n)
        left = 1.5 * sum(per.values()) - sum(target.values())
    target |= {n: left * w[n] / sum(w[m] for m in open_) for n in open_}
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and abs(taken[r.source] - r.target) <= 64
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(spark, df).collect()))
    assert mixing.mix(spark, table(spark, [])).filter("taken > 0").count() == 0


def test_shards_change_the_selection_not_the_sums(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 90))), "en", ("a", "b", "c", None)[min(3, i % 7)], 0, "k", 1) for i in range(400)]
    rows += [(900, "long " * 5000, "en", "b", 0, "k", 1)]  # lies across stretches
    taken, sums = {}, {}
    for shards in (1, 4, 8):
        got = mixing.mix(spark, table(spark, rows), shards=shards).collect()
        assert all(0 <= r.taken <= 2 * r["size"] for r in got) and len(got) == len(rows) + 2
        taken[shards] = {r.doc_id: r.taken for r in got}
        sums[shards] = {r.source: (sum(x.taken for x in got if x.source == r.source), r.target) for r in got}
    assert taken[1] != taken[4] != taken[8] != taken[1]
    for shards in (4, 8):
        assert all(abs(n - sums[1][k][0]) <= 2 * shards and abs(n - t) <= 64 for k, (n, t) in sums[shards].items())


def test_sainte_lague_quotas(spark):
    v = {0: 530.0, 1: 240.0, 2: 230.0, 3: 7.0}
    rows = spark.createDataFrame([(k, x) for k, x in v.items()], "source_id int, target double")
    for shards in (1, 4):
        got = collections.Counter()
        for r in mixing.shard_quotas(rows, 10, shards).collect():
            assert r.blocks >= 0
            got[r.source_id] += r.blocks
        seats = sorted(((-x / (2 * k - 1), i) for i, x in v.items() for k in range(1, 200)))[: round(sum(v.values()) / 10)]
        assert got == collections.Counter(i for _, i in seats)


def brute_repeats(raw, least):
    seen = collections.Counter(r[i : i + least] for r in raw for i in range(len(r) - least + 1))
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                gone[i : i + least] = True
        yield len(r), int(gone.sum()), len(repeats.runs_of(gone)[0]), hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize(("crowd", "marks"), [(64, 1 << 24), (2, 64)])
def test_repeats(spark, monkeypatch, crowd, marks):
    monkeypatch.setattr(repeats, "MARKS", marks)  # 64 bits are soon full: texts without places go through the join too
    rng = np.random.default_rng(8)
    some = lambda n: " ".join(f"{WORDS[int(rng.integers(10))]}{rng.integers(90)}" for _ in range(n))
    common = some(12)
    rows = [(i, f"{some(int(rng.integers(15)))} {common} {some(int(rng.integers(15)))}", "", "", 0, "", 0) for i in range(30)]
    rows += [(100 + i, t, "", "", 0, "", 0) for i, t in enumerate(texts())] + [(200, "x" * 300, "", "", 0, "", 0), (201, "ab" * 150, "", "", 0, "", 0)]
    df = table(spark, rows)
    want = collections.Counter(zip([r.doc_id for r in df.collect()], brute_repeats([(r.text or "").encode() for r in df.collect()], 60), strict=True))
    got = collections.Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in repeats.clean(spark, df, 60, crowd).collect())
    assert got == want
    assert repeats.clean(spark, table(spark, []), 60).count() == 0


def test_language(spark):
    rng = np.random.default_rng(1)
    vocab = {"aa": ["the", "and", "thing", "with"], "bb": ["größe", "über", "schön", "zwölf"], "cc": ["niño", "qué", "ella", "llave"]}
    rows = [(i, " ".join(rng.choice(vocab[k], 40)), k, "s", 0, "", 0) for i in range(150) for k in [("aa", "bb", "cc")[i % 3]]] + [(900, None, "aa", "", 0, "", 0), (901, "123 !!", "aa", "", 0, "", 0), (902, "", None, "", 0, "", 0)]
    got = {r.doc_id: r for r in langid.identify(spark, table(spark, rows), steps=60, batch=60).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    held = [got[r[0]].lang_pred == r[2] for r in rows[:150] if got[r[0]].held_out]
    assert len(held) > 30 and np.mean(held) > 0.95
    assert langid.identify(spark, table(spark, [])).count() == 0


def test_ngram_jaccard(spark):
    df = table(spark)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op10(spark, df).collect())
    rows = df.collect()
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()

    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for r, k in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert got == collections.Counter((r.doc_id, len(s), least.get(k)) for r, s, k in zip(rows, sets, root, strict=True))
    assert jaccard.op10(spark, table(spark, [])).count() == 0


def test_rows_without_id_link_others(spark):
    one = [f"w{i}" for i in range(60)]
    bridge = [*one[:20], "edit", *one[21:]]
    two = [*bridge[:40], "edit", *bridge[41:]]
    rows = [(1, one), (None, bridge), (None, bridge), (2, two), (3, ["apart"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in jaccard.op10(spark, df).collect())
    assert got == {(1, 1): 1, (None, 1): 2, (2, 1): 1, (3, 3): 1}


def test_small_sets_by_subsets():
    assert [jaccard.left_out(n, 90) for n in (9, 10, 19, 20)] == [0, 1, 1, 2]
    assert 1 <= jaccard.boundary({5: 100, 15: 10, 60: 5}, 90) <= 40


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(50, 40), (41, 50), (60, 60)], "a long, b long")
    got = {r.node: r.root for r in components.components(shared.Scratch(spark, "test"), links).collect()}
    assert got == dict.fromkeys(range(31), 0) | dict.fromkeys((40, 41, 50), 40)


def test_pipeline_runs(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50


def test_pipeline_keeps_one_of_near_copies(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(17)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    base, long, short = some(120), some(300), some(14)
    raw = [base, base + some(18), base + some(40), long, list(long), list(long), short, [*short, "more"], short[:9], some(60), base[:3], [*base[:3], "x"], []]
    for i in range(6):
        raw[4][20 + 50 * i] = "edit"
    for i in range(30):
        raw[5][5 + 10 * i] = "edit"
    for i in range(14):  # a crowd of copies, each with two words of its own
        raw.append([f"own{i}", *long[:140], f"end{i}"])
    raw += [some(int(n)) for n in rng.integers(1, 40, 30)]
    rows = [(i, " ".join(w), "en", "s", 0, "k", 1) for i, w in enumerate(raw)]

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets, root = [shingles(w) for w in raw], list(range(len(raw)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    got = sorted(r.doc_id for r in pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert got == sorted(set(root)) and not {1, 4} & set(got)


def test_near_copies_under_repeated_ids(spark):
    one, two = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    near = [*one, "more"]
    rows = [(1, one), (2, near), (2, two), (2, two), (None, [*near, "again"]), (None, ["x"] * 9), (None, ["x"] * 9), (3, [*two, "more"]), (4, []), (4, []), (5, [])]
    df = spark.createDataFrame([(i, " ".join(w), k) for k, (i, w) in enumerate(rows) if k not in (3, 6)] + [(2, " ".join(two), 2), (None, " ".join(["x"] * 9), 5)], "doc_id long, text string, n int")
    got = sorted((r.doc_id or 0, r.text, r.n) for r in jaccard.keep_one(spark, df, 80, 5).collect())
    assert got == sorted([(1, " ".join(one), 0), (2, " ".join(two), 2), (0, " ".join(["x"] * 9), 5), (4, "", 8), (4, "", 9), (5, "", 10)])
