"""Each operator against a brute-force version, on whole small tables and on a table of edge cases."""

import hashlib
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from nearfield.llm import bpe, chat, embed_dedup, hilbert, lm_trie, mixing, quality, simhash, substring
from nearfield.llm.queries import QUERIES, tokenizer_path

PASSAGE = " ".join(f"passage{k}" for k in range(20))
LONG = " ".join(f"w{k * k % 977}" for k in range(30_000))
EDGE = [
    (1, "alpha beta gamma " + PASSAGE, "en", "s1", "x"),
    (2, None, None, None, None),
    (3, "", "en", "s1", ""),
    (4, "   \n\t ", "en", "s2", "x"),
    (5, PASSAGE + " the end\nthe end\nthe end", "fr", "s2", "y"),
    (6, "alpha beta gamma " + PASSAGE, "en", None, "x"),
    (6, "alpha beta gamma " + PASSAGE, "en", None, "x"),
    (None, PASSAGE, "en", "s1", None),
    (7, "one", "en", "s3", "x"),
    (8, LONG, "en", "s3", "x"),
    (9, LONG + " tail", "en", "s3", "x"),
    (10, "ha ha " * 50, "de", "s3", "x"),
    (11, "Ünïcödé wörds 　 日本語 ##|| <b>" + " ok" * 12, "xx", "s\U0001f600", "x"),
    (-5, PASSAGE, "en", "s1", "z"),
]
COLUMNS = "doc_id long, text string, lang string, source string, shard string, size string, fp string, component_id string, key string, doc string, n_chars long"


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, lang, s, e, e, e, e, e, e, len(t) if t is not None else None) for i, t, lang, s, e in EDGE]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(rows, expected):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, expected), key=key)


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


# ---- 1


def reference_scores(rows):
    token = lambda t: [w.lower() for w in brute.words(t)] + [None]
    big, one = Counter(), Counter()
    for i, t in rows:
        if lm_trie.in_training(i):
            w = token(t)
            one.update(w)
            big.update(zip(["begin", *w[:-1]], w))
    n, v = sum(one.values()), len(one)
    follow, contexts, total = Counter(), Counter(), Counter()
    for (a, b), c in big.items():
        follow[a] += 1
        contexts[b] += 1
        total[a] += c

    def discount(counts):
        c = Counter(counts.values())
        return min(0.95, max(0.05, c[1] / (c[1] + 2 * c[2]))) if c[1] and c[2] else 0.5

    d1, d2 = discount(contexts), discount(big)
    unknown = (d1 * v / max(len(big), 1) if v else 1) / (v + 1)

    def p(a, b):
        low = max(contexts[b] - d1, 0) / max(len(big), 1) + unknown
        return low if not total[a] else max(big[a, b] - d2, 0) / total[a] + d2 * follow[a] / total[a] * low

    out = []
    for i, t in rows:
        w = token(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(p(a, b)) for a, b in zip(["begin", *w[:-1]], w))
        out.append((i, not lm_trie.in_training(i), len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out, p, one


@pytest.mark.parametrize("which", ["documents", "edge"])
def test_lm_scores(which, request):
    df = request.getfixturevalue(which)
    got = lm_trie.score_documents(df).collect()
    rows = pairs_of(df)
    expected, p, one = reference_scores(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert len(got) == len(expected)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(expected, key=order)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-8 * b[2])
        assert a[6] == pytest.approx(b[6], abs=1e-3 * b[2])
    some = max(one, key=one.get)
    assert sum(p(some, w) for w in one) + p(some, b"never seen anywhere") == pytest.approx(1)


def test_lm_beats_base_on_held_out(spark):
    held = lm_trie.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    score, base = held.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base + 0.05 * abs(base)


def test_lm_empty(empty):
    assert lm_trie.score_documents(empty).collect() == []


# ---- 2


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_hilbert_rows(which, request):
    df = request.getfixturevalue(which)
    got = hilbert.hilbert_shards(df, 40).collect()
    texts = Counter((i, len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t in pairs_of(df))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by.get(s, [])) for s in range(40)]
    assert set(by) <= set(range(40)) and max(counts) - min(counts) <= 1
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in got)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(spark, dims, bits):
    cells = spark.range(1 << (dims * bits))
    xs = [F.shiftright("id", bits * k).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"x{k}") for k in range(dims)]
    rows = cells.select(hilbert.hilbert_index([x for x in xs], bits).alias("h"), *xs).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(len(rows)))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(rows, rows[1:]))


def test_hilbert_files_prune(documents, edge, tmp_path, spark):
    for k, df in enumerate((documents, edge)):
        hilbert.write_shards(df, f"file://{tmp_path}/out{k}", 8)
        back = spark.read.parquet(f"file://{tmp_path}/out{k}")
        same(back.select(*df.columns).collect(), df.collect())
        stats = hilbert.manifest(hilbert.hilbert_shards(df, 8, pass_through=True), ["source", "n_chars"]).collect()
        assert sum(r["rows"] for r in stats) == df.count() and len(stats) == 8


def test_hilbert_cells_are_not_clipped(spark):
    sizes = [1 << k for k in range(32)] + [100_000, 101_000]
    rows = spark.createDataFrame([(s,) for s in sizes], "size long").select("size", hilbert.log_cell(F.col("size")).alias("c"), hilbert.label_cell(F.col("size").cast("string")).alias("l")).orderBy("size").collect()
    assert len({r["c"] for r in rows}) == len({r["l"] for r in rows}) == len(sizes)
    assert [r["c"] for r in rows] == sorted(r["c"] for r in rows) and rows[-1]["c"] < 1 << hilbert.BITS


# ---- 4


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
@pytest.mark.parametrize("batches", [1, 3])
def test_substring(which, batches, request):
    df = request.getfixturevalue(which)
    got = substring.remove_repeats(df, batches=batches, digests=True).collect()
    same(got, brute.substring(pairs_of(df)))


def test_substring_compacts(documents, spark, tmp_path):
    rows = brute.substring(pairs_of(documents))
    got = substring.remove_repeats(documents, batches=5, fanout=2, digests=True).collect()
    same(got, rows)
    path = f"file://{tmp_path}/index"
    index = substring.SubstringIndex(spark, shards=5, path=path)
    matches = [index.add(documents.where(f"doc_id % 4 = {k}")) for k in range(3)]
    assert [len(x) for x in index.levels] == [1, 1] and index.compactions == 1
    again = substring.SubstringIndex.open(spark, path)  # as another session would
    assert again.levels == index.levels and again.shards == 5
    matches.append(again.add(documents.where("doc_id % 4 = 3")))
    assert [len(x) for x in again.levels] == [0, 0, 1] and again.compactions == 3
    keys = [k for r in again.run(again.runs()[0]).select("keys").collect() for k in substring.unpack_sorted(r["keys"]).tolist()]
    assert len(keys) == len(set(keys))
    assert sorted(p.parent.name for p in tmp_path.glob("index/run-*/run=true")) == again.runs()  # old ones are gone
    every = matches[0]
    for m in matches[1:]:
        every = every.unionAll(m)
    found = {(r["doc"], s) for r in substring.repeats(documents.where("doc_id is not null"), every).collect() for s in r["starts"]}
    first = {}
    texts = [(i, brute.words(t)) for i, t in pairs_of(documents)]
    for i, w in texts:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    assert found == {(i, k) for i, w in texts for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i}


def test_substring_query_compacts(spark, sf, monkeypatch):
    made = []
    close = substring.SubstringIndex.close
    monkeypatch.setattr(substring.SubstringIndex, "close", lambda self: (made.append((self.compactions, [len(x) for x in self.levels])), close(self)))
    QUERIES["op4_substring_dedup"](spark, sf)
    assert made == [(1, [1, 1])]


def test_substring_hot_passage_is_spread():
    from nearfield.llm.quality import blocks
    import pyarrow as pa

    texts = pa.array([f"own{k} words{k} of{k} document{k} {PASSAGE} end{k}".encode() for k in range(1000)])
    block = next(blocks(texts))
    ids, names = np.arange(1000), list(range(16))
    rows = substring._block_entries(block, ids, 13, 5, names).to_pylist()
    also = [len(substring.unpack_sorted(r["also_keys"])) for r in rows]
    leads = [len(substring.unpack_sorted(r["keys"])) for r in rows]
    assert sum(also) > 1000 and max(also) - min(also) <= 1 and max(leads) < 2 * np.median(leads)
    _, keys = substring.fingerprints(block)
    held = [np.unique(keys).view(np.int64)] * 1000
    rows = substring._window_entries(block, ids, held, 13, 5, names)
    also = [len(substring._ids(r[5])) for r in rows]
    assert sum(also) == 999 * 8 and max(also) - min(also) <= 1


def test_substring_text(edge):
    out = {r["doc_id"]: r for r in substring.remove_repeats(edge).where("doc_id is not null").collect()}
    assert out[5]["text"].split() == "the end the end the end".split() and out[5]["shard"] == "y"
    assert out[1]["text"].split() == "alpha beta gamma".split()
    assert out[2]["text"] is None and out[3]["text"] == ""
    assert out[-5]["text"] == PASSAGE
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    assert out[8]["text"] == texts[8] and out[9]["text"].split() == ["tail"]


# ---- 5


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    got = mixing.mix(df).collect()
    rows = df.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(brute.words(r["text"]))
    if rows:
        want = brute.targets({r["source"]: sizes[r["source"]] for r in rows})
    same([(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got], [(r["doc_id"], len(brute.words(r["text"])), sizes[r["source"]], round(want[r["source"]], 6)) for r in rows])
    for r in got:
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(rate + 1e-9) <= r["copies"] + 1e-9 and r["copies"] <= math.ceil(rate - 1e-9) or abs(rate - r["copies"]) < 1e-6
        assert r["copies"] <= 3
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))


def test_mixing_targets_by_hand(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 200), (None, 500), ("d", 0)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    want = brute.targets(dict(sizes))
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1710)
    assert list(mixing.source_targets(spark.createDataFrame([("a", 0)], "source string, size long")).first())[2] == 0


def test_mixing_comes_near_targets(spark):
    df = spark.range(30_000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "repeat('w ', 10) as text")
    for r in mixing.mix(df).groupBy("target", "source_size").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.05)


def test_mixed_rows(edge):
    counts = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(edge).collect()}
    out = mixing.mixed(edge)
    assert out.columns == edge.columns
    assert out.count() == sum(r["copies"] for r in mixing.mix(edge).collect()) and counts


# ---- 6


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_quality_base(which, request):
    df = request.getfixturevalue(which)
    got = quality.quality_rules(df).collect()
    same([tuple(r)[:7] for r in got], [(i, *brute.quality_base(t)) for i, t in pairs_of(df)])
    assert all(not r["kept"] for r in got if r["base_failed"])
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in got)


@pytest.mark.parametrize("which", ["documents", "edge"])
def test_quality_verdict_brute(which, request):
    df = request.getfixturevalue(which)
    limits = quality.Limits()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in df.select("doc_id", "text", "lang").collect()]
    want = brute.quality_kept(rows, limits.class_distance, limits.word_distance)
    for r in quality.quality_rules(df).collect():
        a, b, kept = want[r["doc_id"]]
        assert (r["kept"], r["class_distance"], r["word_distance"]) == (kept, pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9))


def test_quality_verdict_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("crc32(cast(doc_id as string)) % 2 = 1")
    rows = quality.quality_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in rows}
    assert share[1] > 0.995 and share[0] < 0.03


def test_rare_languages_get_a_verdict(spark):
    rng = np.random.default_rng(4)
    stems = {"en": "the of and river to in stone is that field", "nl": "het een van water dat niet huis zijn voor straat", "qq": "ma ki lo pua wai nui hale moku lani aina"}

    def good(lang):
        words = stems[lang].split()
        return " ".join(words[k] + ("." if j % 9 == 8 else "") for j, k in enumerate(rng.integers(0, len(words), 80)))

    def junk():
        return " ".join("#$%|" + str(k) + "|<>" for k in rng.integers(0, 10**6, 80))

    rare = [(i, good("nl"), "nl") for i in range(30)] + [(100 + i, junk(), "nl") for i in range(3)]
    rare += [(200, junk(), "e n"), (201, junk(), "zz"), (202, good("en"), "zz"), (203, good("nl"), None), (204, junk(), None), (205, good("qq"), "en")]
    many = [(1000 + i, good("en"), "en") for i in range(4000)]
    for rows in (rare + many[:100], rare + many):  # nl has 24 % of the documents, then 0.8 %
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
        got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df).where("not base_failed and doc_id < 1000").collect()}
        assert got == {i: i < 100 or i in (202, 203) for i, _, _ in rare}
    assert quality.learn_references(df).languages == ["en", "nl"]


def test_word_distances():
    rng = np.random.default_rng(5)
    p, q = rng.random((6, 9)) * (rng.random((6, 9)) < 0.5), rng.random(9) * (rng.random(9) < 0.6)
    p[2] = 0
    p, q = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-9), q / q.sum()
    doc, column = np.nonzero(p)
    folded = p * (q > 0)
    folded[:, -1] = p[:, -1] + (p * (q == 0))[:, :-1].sum(axis=1)
    assert quality.word_distances(doc, column, p[doc, column], q, 6) == pytest.approx(quality.js_distance(folded, q))


def test_js_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    m = (p + q) / 2
    h = lambda x: -sum(v * math.log2(v) for v in x if v)
    assert quality.js_distance(p, q) == pytest.approx(math.sqrt(h(m) - (h(p) + h(q)) / 2))
    assert quality.js_distance(p, p) == 0


# ---- 7


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_bpe_equals_library(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    library = Tokenizer.from_file(tokenizer_path())
    got = bpe.encode_documents(df, tokenizer_path()).collect()
    expected = []
    for i, t in pairs_of(df):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), str(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same([(r["doc_id"], r["n_tokens"], str(list(r["ids"])), r["ids_sha256"], r["decoded_sha256"]) for r in got], expected)


def test_bpe_on_strange_texts():
    import random

    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path()), bpe.WordBpe(tokenizer_path())
    rng = random.Random(3)
    bits = ["a", "the", "é", "ß", "İ", "Σ", "́", "1", "'s", "'ll", "'", "!", " ", "\n", "\x1c", "　", "漢", "😀", "‍", "<|endoftext|>", "<|startoftext|>", "##", "aaaa"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(1, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    long = "abcdefgh" * 20_000
    assert own.encode(long) == library.encode(long, add_special_tokens=False).ids


def test_suffix_automaton():
    import random

    rng = random.Random(1)
    for trial in range(200):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))): 0 for _ in range(rng.randrange(1, 25))}
        vocabulary = {w: k for k, w in enumerate(vocabulary)}
        auto = bpe.SuffixAutomaton(vocabulary)
        inside = {w[i:j] for w in vocabulary for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        text, state, held = "".join(rng.choice("abcd") for _ in range(40)), 0, 0
        for end, c in enumerate(text, 1):
            while (to := auto.step.get(state << auto.WIDTH | ord(c))) is None and state:
                state = auto.link[state]
                held = auto.size[state]
            state, held = (0, 0) if to is None else (to, held + 1)
            assert held == max([n for n in range(end + 1) if text[end - n : end] in inside], default=0)
            found = [(n, v) for n, v in auto.ends[state] if n <= held]
            assert found == [(n, vocabulary[text[end - n : end]]) for n in range(end, 0, -1) if text[end - n : end] in vocabulary]


def test_bpe_takes_no_other_kind(tmp_path):
    import json

    with open(tokenizer_path()) as f:
        spec = json.load(f)
    for part, value in (("decoder", {"type": "ByteLevel"}), ("normalizer", None), ("normalizer", {"type": "Sequence", "normalizers": [{"type": "NFC"}]}), ("pre_tokenizer", {"type": "ByteLevel"})):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | {part: value}))
        with pytest.raises(ValueError):
            bpe.WordBpe(str(other))


# ---- 8


def test_embeddings_brute(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = embed_dedup.near_vectors(vectors).collect()
    same(got, brute.embeddings([tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]))


def test_embeddings_edges(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    rows = [(k, (base + 0.03 * rng.normal(size=16)).tolist(), 1) for k in range(60)]
    rows += [(100 + k, base.tolist(), 1 if k % 2 else 2) for k in range(9)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, base.tolist(), None), (None, base.tolist(), 1), (205, [], 1), (206, base.tolist()[:8], 1), (207, (base * 1e200).tolist(), 1), (100, base.tolist(), 2)]
    rows += [(300 + k, rng.normal(size=16).tolist(), 1) for k in range(40)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, unit string, id string").repartition(4)
    expected = brute.embeddings([r if r[0] != 207 else (207, base.tolist(), 1) for r in rows])
    same(embed_dedup.near_vectors(df).collect(), expected)
    same(embed_dedup.near_vectors(df, chunk=7).collect(), expected)  # chunks of one bucket meet in pairs
    same(embed_dedup.near_vectors(df, bits=2, tables=40, chunk=20).collect(), expected)
    assert embed_dedup.near_vectors(df.limit(0)).collect() == []
    assert embed_dedup.recall_of(0.98) > 0.9999


def test_embeddings_recall():
    assert embed_dedup.recall_of(embed_dedup.THRESHOLD) >= embed_dedup.recall_of(0.98, 14, 24) > 0.99999
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20_000, 64))
    y = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    assert (embed_dedup.sign_codes(x) == embed_dedup.sign_codes(y)).any(axis=1).sum() >= 19_999


# ---- 9


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    got = simhash.near_duplicates(df)
    same(got.select("doc_id", "fingerprint", "component_id").collect(), brute.simhash(pairs_of(df)))


@pytest.mark.parametrize("split", [5, 40])
def test_simhash_splits_large_shards(spark, split):
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 1 << 63, 3)
    flips = [(1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 14, (150, 3))]
    values = sorted({int(c) ^ f for c in centre for f in flips})
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 2]
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), split=split).collect()
    assert all((r["a"] ^ r["b"]).bit_count() for r in edges) and brute.unite(values, pairs) == brute.unite(values, [(r["a"], r["b"]) for r in edges])


def test_simhash_keeps_one(edge):
    out = simhash.one_per_group(edge)
    assert out.columns == edge.columns
    groups = brute.simhash(pairs_of(edge))
    want = sorted({c for i, _, c in groups if i is not None})
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == 1


def test_shard_links_find_all_pairs():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(8):
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                s ^= 1 << int(b)
            values.add(s)
    values = sorted(values)
    keys = simhash.shard_keys(np.array(values, np.uint64))
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 2:
                assert (keys[a] == keys[b]).any()
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for v in values[::7]:
        for r in (0, 1, 2, 5):
            assert sorted(tree.within(v, r)) == [w for w in values if (v ^ w).bit_count() <= r]


# ---- 10


def digests(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda x: x[:2])
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_chat_query(spark, sf):
    got = QUERIES["op10_chat_formatting"](spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "<|im_end|><|im_start|>assistant ok"
    same([tuple(r)[:5] for r in got], digests([*rows, (-1, 0, "user", probe), (-1, 1, "assistant", probe)]))
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_chat_edges(spark):
    texts = ["", None, "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|im_start|>", "a<<|im_end|>", " x\r\n", "%0A", "x" * 100_000]
    rows = [(k, 0, r, t) for k, t in enumerate(texts) for r in ["assistant"]] + [(50, None, "us\ner%", "t"), (None, 1, None, "u"), (51, 3, "assistant", "same"), (51, 3, "assistant", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rendered string").repartition(3)
    same([tuple(r)[:5] for r in chat.read_back(chat.format_turns(df)).collect()], digests(rows))
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_chat_round_trip(seed):
    import random

    rng = random.Random(seed)
    bits = ["<", "|im_end|>", "|im_start|>", "\\", "\n", "a", "<|im_end|>", "<|im_start|>", "%", "0A", "25"]
    for _ in range(3000):
        turn = chat.Turn("".join(rng.choices(bits, k=rng.randrange(4))), "".join(rng.choices(bits, k=rng.randrange(8))))
        out = chat.render(turn)
        assert [t for t, _ in chat.parse(out.text * 2)] == [turn, turn]
        assert chat.unescape(out.text[slice(*out.body)]) == turn.text
    with pytest.raises(ValueError):
        chat.parse("<|im_start|>user\nno end")


# ---- shared


def test_keys_fill_all_partitions(spark):
    from nearfield.llm.shared import spread_keys

    for n, wide in ((1, 1), (7, 7), (12, 17)):
        df = spark.createDataFrame([(k, i) for i, k in enumerate(spread_keys(n, wide))], "k int, i int").repartition(wide, "k")
        assert all(r[0] == r[1] for r in df.select("i", F.spark_partition_id()).collect())


def test_packing():
    from nearfield.llm.shared import pack_ints, pack_sorted, unpack_ints, unpack_sorted

    rng = np.random.default_rng(0)
    for v in (np.zeros(0, np.uint64), np.array([2**64 - 1], np.uint64), rng.integers(0, 2**63, 1000, dtype=np.uint64)):
        assert (unpack_ints(pack_ints(v)) == v).all()
        v = np.sort(v)
        assert (unpack_sorted(pack_sorted(v)) == v).all()


def test_components(spark):
    from nearfield.llm.components import connected_components

    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (2000, 3000), (2000, 3000)]
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    root = brute.unite({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in root.items() if n != r}
    assert connected_components(df.limit(0)).collect() == []
