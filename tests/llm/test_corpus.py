import base64
import hashlib
import json
import random
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from sextant.llm import ann, bpe, bytebpe, common, neardup, packing, quality, queries, sharding, simhash, suffixdedup, tokencount, toolcalls, warc  # noqa: E402
from sextant.llm.components import components  # noqa: E402

SF = "/root/testdata/sf0.001"
random.seed(7)
PROSE = "".join(random.choice("abcde é\n") for _ in range(900))
WORDS = [random.choice("abcdefghij") * random.randint(1, 3) + str(random.randint(0, 99)) for _ in range(400)]
#: Nulls, empty and very long texts, ties, repeated rows, several scripts, a repeated null id.
ROWS = [
    (1, PROSE), (2, PROSE[:300] + "X" + PROSE[300:]), (3, "a" * 500), (4, None), (5, ""), (6, PROSE[100:299]), (7, PROSE[100:300]), (8, "ab" * 210),
    (9, PROSE), (9, PROSE), (None, "\0" * 450), (None, "\0" * 450), (10, "zz" + PROSE[200:480] + "qq" + PROSE[650:]), (11, "\0" * 260 + PROSE[5:210]),
    (12, " ".join(WORDS)), (13, " ".join([*WORDS[:-1], "other"])), (14, " ".join(["new", *WORDS])), (15, "Ünï ￿ 漢字 😀 ﷺ  \t x\r\n y <|endoftext|> don't  "),
    (16, "Don't stop, HELLO World! 12345 " * 3), (17, " \n\t "), (18, "x " * 40_000), (19, "ΣΑΣ İstanbul ǅ ﬁ é é"),
]


@pytest.fixture(scope="module")
def documents(spark):
    """With columns that clash with outputs."""
    d = spark.createDataFrame([(i, t, "en", 1, 2, "x") for i, t in ROWS], "doc_id long, text string, lang string, n_tokens int, component_id int, block string")
    return d.repartition(3)


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.where("false")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def want(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("length", "hot"), [(200, 10**6), (200, 1), (20, 10**6), (21, 2)])
def test_repeats_are_removed(spark, documents, nothing, length, hot):
    rows = [(d, t) for d, t in ROWS if d != 18]
    assert got(suffixdedup.remove_repeats(documents.where("doc_id is null or doc_id <> 18"), length, hot=hot)) == want(brute.removed(rows, length))
    assert got(suffixdedup.remove_repeats(nothing)) == []


def test_one_long_repetitive_text(spark):
    text = "0123456789" * 60_000
    d = spark.createDataFrame([(1, text), (2, "tail")], "doc_id long, text string")
    assert [r[:4] for r in got(suffixdedup.remove_repeats(d))] == [(1, 600_000, 600_000, 1), (2, 4, 0, 0)]


def test_triggers_lie_in_every_window():
    data = np.frombuffer((PROSE * 3).encode(), np.uint8)
    x, lo, hi, _ = suffixdedup.triggers(data, np.array([500, len(data)]))
    assert (x >= lo).all() and (x + 100 <= hi + 200).all() and (x + 100 <= lo + 200).all()
    assert sum(hi - lo + 1) == (500 - 199) + (len(data) - 500 - 199)


@pytest.mark.parametrize(("width", "radius"), [(3, 2), (5, 3)])
def test_simhash_components(documents, nothing, width, radius):
    assert got(simhash.near_duplicates(documents, width, radius)) == want(brute.simhash(ROWS, width, radius))
    assert got(simhash.near_duplicates(nothing, width, radius)) == []


def test_simhash_links_in_small_tiles(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    values = sorted({int(b) ^ sum(1 << int(i) for i in rng.integers(0, 62, k)) for b in base for k in (0, 1, 2, 3, 5)})
    links = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, tile=8).collect()]
    mine = {frozenset(x) for x in links}
    at = {v: i for i, v in enumerate(values)}
    same = brute.groups(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)
    assert brute.groups(len(values), lambda i, j: frozenset((values[i], values[j])) in mine) == same and all(at[a] != at[b] for a, b in links)


def test_every_pair_of_tiles_meets_once(spark):
    """Also of a class with many tiles, whose pairs are dealt over several keys."""
    rows = [(int(c), 1000 * c + i) for c, n in ((3, 120), (4, 5), (6, 40)) for i in range(n)]
    made = common.tiled(spark.createDataFrame(rows, "class long, v long"), 4, F.xxhash64("v"))
    pairs = common.tile_pairs(made, [0, 1])
    met = Counter(tuple(sorted((x["v"], y["v"]))) for r in pairs.collect() for x in r["mine"] for y in r["theirs"] if (r["by"], r["tile"]) != (0, r["tile2"]))
    met += Counter(p for r in pairs.where("by = 0 and tile = tile2").collect() for p in combinations(sorted(x["v"] for x in r["mine"]), 2))
    assert met == Counter((x, y) for (c, x), (d, y) in combinations(sorted(rows, key=lambda r: r[1]), 2) if d - c in (0, 1))
    assert pairs.select("class", F.floor(F.col("tile2") / common.GROUP)).distinct().count() > 5


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(e, "a", "b").collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_of_random_links(spark):
    """By brute force, of binary nodes as well; many links, and one giant component."""
    rng = random.Random(9)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)] + [(5000, 5001 + i) for i in range(500)] + [(6000 + i, 6001 + i) for i in range(700)]
    parent = {x: x for e in links for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        p, q = top(x), top(y)
        parent[max(p, q)] = min(p, q)
    want_ = {x: top(x) for e in links if e[0] != e[1] for x in e}
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["root"] for r in components(frame, "a", "b").collect()} == want_
    as_bytes = frame.select(*(F.encode(F.lpad(F.col(c).cast("string"), 6, "0"), "UTF-8").alias(c) for c in "ab"))
    assert {int(r["node"]): int(r["root"]) for r in components(as_bytes, "a", "b").collect()} == want_
    assert got(components(frame.where("a < 0"), "a", "b")) == []


def test_near_duplicates_by_similarity(documents, nothing):
    kept = neardup.without_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == brute.near_duplicates_kept(ROWS, 5, 0.8)
    assert got(neardup.without_near_duplicates(nothing)) == []


def edited(rng, words, n, edits):
    """Copies of the words with others in place of random ones."""
    out = []
    for k in range(n):
        copy = list(words)
        for i in rng.sample(range(len(words)), rng.choice(edits)):
            copy[i] = f"edit{k}x{i}"
        out.append(copy)
    return out


def test_near_duplicates_where_closer_candidates_fail(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(w)) for i, w in enumerate(edited(rng, [f"w{x}" for x in range(300)], 300, [4]))]
    kept = neardup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == brute.near_duplicates_kept(rows, 5, 0.8)


def test_near_duplicates_of_planted_clusters(spark):
    """Eight texts of 200 words in 60 variants of two to six other words each, so most pairs of a cluster are near the threshold."""
    rng = random.Random(1)
    texts = [" ".join(v) for k in range(8) for v in edited(rng, [f"w{k}x{rng.randrange(900)}" for _ in range(200)], 60, [2, 3, 4, 5, 6])]
    rows = list(enumerate(texts))
    kept = sorted((r["doc_id"] for r in neardup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == brute.near_duplicates_kept(rows, 5, 0.8) and 8 < len(kept) < 480


def test_near_duplicates_at_the_threshold(spark):
    """Of 5 and 4 shingles, and of 23 and 22, of which 4 and 20 are shared; and copies of many similarities."""
    rng = random.Random(5)
    texts = [" ".join(w) for w in edited(rng, [f"w{x}" for x in range(160)], 200, [2, 3, 4])]
    for k in range(80):
        short, longer = ([f"{c}{k}x{x}" for x in range(n)] for c, n in (("s", 9), ("l", 24)))
        texts += [" ".join(short), " ".join(short[1:]).upper(), " ".join(longer + ["a1", "a2", "a3"]), " ".join(["b1", "b2", *longer])]
    rows = list(enumerate(texts))
    kept = neardup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == brute.near_duplicates_kept(rows, 5, 0.8)


def test_byte_bpe(documents, nothing):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for d, t in ROWS:
        ids = np.array(right.encode_ordinary(t or ""), "<u4").tobytes()
        expected.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    out = bytebpe.round_trip(documents, path)
    assert got(out.drop("n_split", "whole")) == want(expected) and out.where("not whole").count() == 0
    assert out.where("doc_id = 15").first()["n_split"] > 0
    assert got(bytebpe.round_trip(nothing, path)) == []
    both = bytebpe.decode(bytebpe.encode(documents, path, offsets=True).drop("n_tokens"), path).select("doc_id", "decoded", "starts", "ends")
    for d, text, starts, ends in both.collect():
        assert d is None or text == (dict(ROWS)[d] or "")
        assert not text or (starts[0] == 0 and ends[-1] == len(text) and all(b <= e for b, e in zip(starts[1:], ends, strict=False)))


def test_built_tokenizer_gives_the_ids_of_its_ranks():
    """On text of few letters, where many merges compete, and on every character with neighbours."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choices("aet ns\né漢か1.ово'", k=rng.randrange(1, 60))) for _ in range(3000)]
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    texts += [f"a{every[i : i + 11]}1 {every[i : i + 11]}" for i in range(0, len(every), 11)]
    assert bytebpe.encode_texts(path, texts) == [np.array(x, "<u4").tobytes() for x in right.encode_ordinary_batch(texts)]


def test_last_merges():
    order = {b"a": 0, b"b": 1, b"ab": 2, b"aa": 3, b"aab": 4, b"abab": 5, b"bb": 6}
    assert bpe.last_merge(b"aab", order) == (b"a", b"ab") and bpe.last_merge(b"abab", order) == (b"ab", b"ab") and bpe.last_merge(b"bb", order) == (b"b", b"b")
    assert bpe.last_merge(b"aba", order) == (b"ab", b"a") and bpe.last_merge(b"bbaa", order | {b"bbaa": 9}) == (b"bb", b"aa")
    assert bpe.last_merge(b"cab", order) is None or b"ab" in bpe.last_merge(b"cab", order)


def test_segments_join_to_the_text():
    texts = ["a b\nc", " lead", "two  spaces \n x", "zero\0 b \0", "\0", "", "tab\tx y", "nb\xa0sp c", "x \u2003y z", "漢字 か"]
    cut = bpe.segments(pa.array(texts)).to_pylist()
    assert ["".join(x) for x in cut] == texts
    assert all(b[0] in " \n" and not a[-1].isspace() for x in cut for a, b in zip(x, x[1:], strict=False) if a)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3000)
    memo, asked = bpe.Memo(), []
    for k in range(50):
        parts = [f"{(k * 3 + i) % 40}" for i in range(6)]
        assert memo.values(parts, lambda new: asked.extend(new) or [x.encode() for x in new]) == [x.encode() for x in parts]
    assert len(memo.young) + len(memo.old) <= 25 and len(asked) > 40


def test_pattern_is_the_public_one():
    assert bytebpe.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(documents, nothing, name):
    path = public_tokenizers.path(name)
    if name.endswith("json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    else:
        from sentencepiece import SentencePieceProcessor

        count = lambda t, m=SentencePieceProcessor(model_file=path): len(m.encode(t))
    texts = pa.array([t for _, t in ROWS], pa.string())
    assert tokencount.count_column(path, texts.slice(3, 9), 500, 8).tolist() == [count(t or "") for _, t in ROWS[3:12]]
    out = tokencount.count_tokens(documents, path, chunk=500, overlap=8)
    assert set(out.columns) == {*documents.columns, "n_bytes", "over_limit"} - {"text"} | {"text"}
    expected = [(d, len((t or "").encode()), n := count(t or ""), n > 512) for d, t in ROWS]
    assert got(out.select("doc_id", "n_bytes", "n_tokens", "over_limit")) == want(expected)
    assert got(tokencount.count_tokens(nothing, path)) == []


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 2), (300, 16), (5000, 64)])
def test_spliced_counts_equal_whole_ones(chunk, overlap):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = bpe.tokenizer(path)
    rng = random.Random(4)
    mixed = "".join(rng.choices(["don't ", "'s", "  ", "\n\n", "abc", "<|endoftext|>", "漢", "é", "1234", "!!! ", "'ll ", "\t"], k=3000))
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000))
    others = (mixed, chinese, "a" * 9000, " " * 9000, "no-stable-boundary" * 300, "word<|endoftext|> a " * 50)
    for text in (*((t or "")[:20_000] for _, t in ROWS), *others):
        assert tokencount.count_huge(path, text, chunk, overlap) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_a_huge_text_without_spaces_takes_linear_time(monkeypatch):
    """No more than four times its bytes are encoded."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(8)
    sizes = []
    inner = tokencount._tokens
    monkeypatch.setattr(tokencount, "_tokens", lambda p, d, a, b: sizes.append(b - a) or inner(p, d, a, b))
    for text in ("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200_000)), "ab" * 300_000):
        sizes.clear()
        tokencount.count_huge(path, text)
        assert sum(sizes) < 4 * len(text.encode())


def test_quality_statistics(documents, nothing):
    out = quality.statistics(documents)
    found = out.select("doc_id", *quality.STATISTICS)
    assert got(found) == want([(d, *brute.statistics(t)) for d, t in ROWS])
    assert quality.statistics(nothing).count() == 0


def test_rules_are_learned_and_applied(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(30)), 1) for i in range(120)]
    bad = [(1000 + i, " ".join(f"#{i}$y{j} **" for j in range(30)), 0) for i in range(120)]
    d = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(5000, "short"), (5001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(7, None, None)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judged(d, labels).collect()}
    assert all(kept[i] == (False, True) for i, _, _ in good) and all(kept[i] == (False, False) for i, _, _ in bad)
    assert kept[5000] == kept[5001] == (True, False)
    untaught = quality.judged(d, labels.where("false"))
    assert untaught.where("kept").count() == 240


def test_verdicts_equal_the_learned_rules_row_by_row(spark):
    """On a whole table, with features counted by brute force: the first rule that holds rejects, and nothing else does."""
    sf = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality.learn_from(documents, labels)
    assert rules
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in quality.judged(documents, labels).select("doc_id", *quality.STATISTICS, "n_lines", "n_upper", "n_marks", "base_failed", "rule", "kept").collect():
        n, chars, symbols, lines, again = brute.statistics(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, again)
        w, c, k = max(n, 1), max(chars, 1), max(r["n_lines"], 1)
        row = dict(zip(quality.FEATURES, (n, chars / w, symbols / w, lines / k, again / w, r["n_upper"] / c, r["n_marks"] / w), strict=True))
        first = next((f"{i + 1}: " + " and ".join(map(str, rule)) for i, rule in enumerate(rules) if all(x.holds(row) for x in rule)), None)
        failed = n < 20 or 100 * again > 30 * n
        assert (r["base_failed"], r["rule"], r["kept"]) == (failed, first, not failed and first is None)


def test_rules_are_grown_pruned_and_in_order():
    def row(bad, **values):
        return dict.fromkeys(quality.FEATURES, 0.0) | values, bad

    a, b = quality.FEATURES[1], quality.FEATURES[2]
    # Bad rows are those of high a, and of high b with low a; b alone says nothing.
    rows = [row(True, **{a: 10.0 + i % 3, b: float(i % 2)}) for i in range(90)] + [row(False, **{a: 1.0 + i % 3, b: float(i % 2)}) for i in range(90)]
    random.Random(1).shuffle(rows)
    rules = quality.learn(rows)
    assert len(rules) == 1 and [c.feature for c in rules[0]] == [a] and rules[0][0].above and 3 < rules[0][0].threshold < 10
    # The rule that covers most comes first, and what it covers is gone when the next is learned.
    rows += [row(True, **{a: 2.0, b: 50.0 + i % 5}) for i in range(30)]
    random.Random(2).shuffle(rows)
    rules = quality.learn(rows)
    assert [[c.feature for c in r] for r in rules] == [[a], [b]]
    # A condition that only fits the rows it was grown on goes again.
    grown = (quality.Condition(a, True, 5.0), quality.Condition(b, True, 0.5))
    assert quality._prune([row(True, **{a: 9.0}), row(True, **{a: 9.0, b: 1.0}), row(False, **{a: 1.0, b: 1.0})], grown) == grown[:1]


def test_learning_without_bad_rows():
    assert quality.learn([]) == [] and quality.learn([({f: 1.0 for f in quality.FEATURES}, False)] * 50) == []


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((400, 16)).astype("f4")
    v[7] = v[3]
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    odd = [(1000, None), (1001, [0.0] * 16), (1050, [float("nan")] * 16), (1100, [None] * 16), (1150, [float("inf")] * 16), (None, rows[1][1]), (50, rows[50][1])]
    e = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    out = defaultdict(list)
    for r in ann.nearest(e, block=64, queries=3).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(out) == list(range(0, 400, 50))
    x = v.astype(float)
    hits = 0
    for q, found in out.items():
        s = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum()))
        s[q] = -9
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        hits += len({f[1] for f in found} & set(np.lexsort([np.arange(400), -s])[:5].tolist()))
    assert hits >= 0.9 * 5 * len(out)
    assert got(ann.nearest(e.where("false"))) == []
    assert [r["vec_id"] for r in ann.nearest(e.where("vec_id in (0, 3, 7)")).orderBy("rank").collect() if r["query_id"] == 0] in ([3, 7], [3, 7][::1])


def test_a_search_stores_no_copy_of_the_vectors(spark, monkeypatch):
    """Only queries are written, and they and the vectors move once each, as blocks."""
    stored, write = [], ann.written
    monkeypatch.setattr(ann, "written", lambda df, name: (stored.append(write(df, name)), stored[-1])[1])
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 8))
    v[250:] = v[0]  # ties beyond a block go to the smaller id
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    found = defaultdict(list)
    for r in ann.nearest(e, block=16, queries=2).orderBy("rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert found[0] == [250, 251, 252, 253, 254] and found[250] == [0, 251, 252, 253, 254] and len(found) == 6
    assert sum(len(r["ids"]) // 8 for df in stored for r in df.collect()) == 6


@pytest.mark.parametrize("dim", [16, 100])
def test_estimates_from_bits(dim):
    """Are the products with the signs, but for rounding, and off by no more than allowed for in about 19 of 20."""
    rng = np.random.default_rng(5)
    v, q = rng.standard_normal((500, dim)), rng.standard_normal((20, dim))
    codes, along = ann.encode(v, 3)
    guess, error = ann.estimate(codes, along, q, 3, 1.9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    signs = np.where(unit(v) @ ann.rotation(dim, 3).T >= 0, 1, -1) / np.sqrt(dim)
    assert np.abs(guess - unit(q) @ ann.rotation(dim, 3).T @ signs.T / along).max() < 0.08
    assert (np.abs(guess - unit(q) @ unit(v).T) <= error).mean() > 0.94


def test_an_id_with_several_vectors_is_found_once(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.9, 0.1, 0.0]), (1, [0.8, 0.1, 0.0]), (1, [0.99, 0.0, 0.0]), (2, [0.1, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])]
    for block in (2, 100):
        found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, block=block).orderBy("rank").collect()
        assert [(r["rank"], r["vec_id"]) for r in found] == [(1, 1), (2, 2), (3, 3)] and found[0]["score"] == 1.0


def test_packing(documents, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["don't I've 'S x's", "<|endoftext|> a<|startoftext|>b", "Å ÅNGSTRÖM é́", "12ab34--..'' '", "x<|y", "a\0b", "`~^_|{}[]\\", "\u212a\u0130"]
    texts = [*(t for _, t in ROWS), *odd]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        ids, ends = packing.encode_texts(public_tokenizers.path(name), pa.array(texts, pa.string()), 7)
        other = Tokenizer.from_file(public_tokenizers.path(name))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*other.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    rows = packing.packed_documents(documents, path, 256).collect()
    bins, ids = defaultdict(list), defaultdict(int)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        ids[r["doc_id"]] += r["length"]
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    text = dict((d, t) for d, t in ROWS if d is not None)
    for d, n in ids.items():
        if d not in (None, 9):
            assert n == len(tokenizer.encode(text[d] or "", add_special_tokens=False).ids) + 1
    long = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 12)
    whole = np.array([*tokenizer.encode(text[12], add_special_tokens=False).ids, 0], "<u4")
    assert [(p, s, n, zlib.crc32(whole[s : s + n].tobytes())) for p, s, n, _ in long] == long
    assert got(packing.packed_documents(nothing, path)) == []


def test_best_two_fit_against_brute_force():
    """The plan by counts makes the bins that packing piece by piece makes."""
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 64, 100])
        sizes = [rng.choice([rng.randint(1, capacity), rng.randint(1, 9), capacity // 3]) for _ in range(rng.randint(1, 300))]
        plan = packing.best_two_fit(dict(Counter(sizes)), capacity)
        made = [sorted(m, reverse=True) for m, times in plan for _ in range(times)]
        assert sorted(made) == sorted(brute.best_two_fit(sizes, capacity))
        assert Counter(x for m in made for x in m) == Counter(sizes) and all(sum(m) <= capacity for m in made)


def test_two_pieces_take_the_place_of_one():
    made, times = packing.best_two_fit({60: 1, 30: 1, 25: 1, 14: 1}, 100)[0]
    assert (sorted(made), times) == ([14, 25, 60], 1)  # 30 went out for 25 and 14, which fill 39 of 40


def least_capacity(sizes, shards):
    """The least of all sums of neighbours that is enough."""
    ends = [0]
    for x in sizes:
        ends.append(ends[-1] + x)
    need = max([0, -(-ends[-1] // shards), *sizes])
    for low in sorted({b - a for i, a in enumerate(ends) for b in ends[i:] if need <= b - a <= need + max([0, *sizes])}):
        n, at = 1, 0
        for x in sizes:
            if at + x > low:
                n, at = n + 1, 0
            at += x
        if n <= shards:
            return low


def test_cuts_are_least():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice([rng.randint(1, 30), 2, 300 if rng.random() < 0.05 else 3]) for _ in range(rng.randint(0, 25))]
        k = rng.randint(1, 9)
        capacity, at = sharding.cuts(sizes, k)
        assert capacity == least_capacity(sizes, k) and len(at) == k - 1
        ends = [0, *at, len(sizes)]
        parts = [sum(sizes[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        assert max(parts) <= capacity and (0 in parts) == (len(sizes) < k)


@pytest.mark.parametrize(("giant", "coarse", "finer", "at_once"), [(0, 2, 3, 1), (400, 4, 2, 3), (400, 16, 8, 256)])
def test_boundaries_of_a_table_are_least(spark, giant, coarse, finer, at_once):
    """Found by stretches, but as of all groups; with a text that many rows have."""
    rng = random.Random(giant)
    groups = {rng.randrange(2**63): rng.randint(1, 900) for _ in range(1500)} | ({rng.randrange(2**63): giant * 5000} if giant else {})
    rows = [(o, n) for o, n in groups.items()] + [(o, 1) for o in list(groups)[:50]]
    found = sharding.boundaries(spark.createDataFrame(rows, "__order long, size long"), 8, coarse, finer, at_once)
    whole = defaultdict(int)
    for o, n in rows:
        whole[o] += n
    parts = [0] * 8
    for o, n in whole.items():
        parts[sum(o >= b for b in found)] += n
    assert len(found) == 7 and max(parts) == least_capacity([whole[o] for o in sorted(whole)], 8) and min(parts) > 0


def test_no_shard_stays_empty_beside_a_giant_group(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, F.repeat(F.lit("y"), 5000)).otherwise(F.concat(F.repeat(F.lit("x"), (F.col("id") % 200).cast("int")), F.col("id").cast("string"))).alias("text"))
    sums = sorted(r["n"] for r in sharding.shard_documents(d).groupBy("shard").agg(F.sum("size").alias("n")).collect())
    assert len(sums) == 8 and sums[-1] == 400 * 5001


def test_shards(spark, documents, nothing):
    slots, of = defaultdict(list), defaultdict(set)
    text = dict((d, t) for d, t in ROWS)
    for r in sharding.shard_documents(documents).collect():
        body = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "bytes", None) and 0 <= r["shard"] < 8
        slots[r["shard"]].append(r["slot"])
        of[body].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    assert sum(map(len, slots.values())) == len(ROWS) and got(sharding.shard_documents(nothing)) == []
    even = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("t"), F.concat("t", F.col("id").cast("string")).alias("text"))
    sums = [r["n"] for r in sharding.shard_documents(even).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 8 * 60


DATE = "2026-01-01T00:00:00Z"


def test_warc(spark):
    html = '<html lang="de"><head><title>A &amp; B</title></head><body><script>var t="</p>";</script><p>Eins<br>zwei</p><a href="/x?a=1&amp;b">drei</a><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "http://a/x", html), (2, None, None), (2, None, None), (3, "u", "")], "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    out = [r.asDict() for r in warc.derivatives(warc.archived(pages, DATE)).collect()]
    assert len(out) == 8
    one = {r["record_type"]: r for r in out if r["key"] == 1}
    (head, block), (source, about) = (next(warc.parse(bytes(one[k]["record"]))) for k in ("conversion", "metadata"))
    head, source = dict(head), dict(source)
    assert block.decode() == "Eins\nzwei\ndrei" and head["WARC-Refers-To"] == source["WARC-Refers-To"] == one["metadata"]["refers_to"] and head["WARC-Target-URI"] == "http://a/x"
    assert head["WARC-Payload-Digest"] == warc.digest(html.encode()) and head["WARC-Block-Digest"] == warc.digest(block) and b"title: A & B" in about and b"outlink: /x?a=1&b" in about
    assert ["WARC-Type", "response"] in json.loads(about.decode().split("source-headers: ")[1].split("\r\n")[0])
    assert warc.derivatives(warc.archived(pages.where("false"), "x")).count() == 0
    assert warc.derivatives(spark.createDataFrame([(1, None), (2, b""), (3, b"WARC/1.0\r\n")], "key long, content binary")).count() == 0


def test_warc_of_all_pages_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = warc.derivatives(warc.archived(pages, DATE)).collect()
    expected = [x for r in pages.collect() for x in brute.warc(r["page_id"], r["url"], r["html"], DATE)]
    assert want([(*r[:-1], bytes(r["record"])) for r in rows]) == want(expected)


def record(block, *more, **heads):
    named = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), *more, ("Content-Length", str(len(block)))]
    return warc.serialise([(n, heads.get(n.replace("-", "_"), v)) for n, v in named if heads.get(n.replace("-", "_"), v) is not None], block)


def test_warc_files(spark, tmp_path):
    import gzip

    whole = record(b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hi</p>", ("WARC-Target-URI", "u"))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(whole) + gzip.compress(whole)[:20])
    (tmp_path / "b.warc").write_bytes(whole[:-30])
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(whole)[:40])
    out = warc.derivatives(warc.read(spark, str(tmp_path)))
    assert sorted(r["record_type"] for r in out.collect()) == ["conversion"] * 2 + ["metadata"] * 2
    assert bytes(out.where("record_type = 'conversion'").first()["record"]).endswith(b"\r\n\r\nhi\r\n\r\n")


def test_damaged_and_odd_warc_records():
    good = record(b"<p>a")
    for odd in (record(b"x", Content_Length="abc"), record(b"x", Content_Length=""), record(b"x", Content_Length="-5"), b"WARC/1.0 rubbish\r\n\r\n", b"rubbish"):
        assert [b for _, b in warc.parse(odd + good)] == [b"<p>a"]
    assert list(warc.parse(record(b"x", Content_Length="99999"))) == [] and list(warc.parse(b"")) == []
    heads, _ = next(warc.parse(record(b"", ("X-A", "1"), ("x-a", "2"))))
    assert [v for n, v in heads if n.lower() == "x-a"] == ["1", "2"]
    nameless = warc.derive([("WARC-Target-URI", "u")], b"hi")
    assert [r["refers_to"] for r in nameless] == [None, None] and b"Refers-To" not in nameless[0]["record"]
    assert len({r["record_id"] for r in nameless}) == 2 and nameless == warc.derive([("WARC-Target-URI", "u")], b"hi")


def test_http_headers_say_how_a_payload_is_read():
    import gzip
    import zlib as z

    text = "größe"
    for head, body in (("Content-Type: text/html; charset=ISO-8859-1", text.encode("latin-1")), ("Content-Encoding: gzip", gzip.compress(text.encode())), ("content-encoding: deflate", z.compress(text.encode())), ("Content-Encoding: gzip", gzip.compress(text.encode() * 1)), ("Transfer-Encoding: chunked", b"3\r\ngr\xc3\r\n4;x=y\r\n\xb6\xc3\x9fe\r\n0\r\n\r\n"), ("Content-Type: text/html; charset=no-such", text.encode())):
        headers, payload = warc.http(b"HTTP/1.1 200 OK\r\n" + head.encode() + b"\r\n\r\n" + body)
        assert warc.page_of(headers, payload) == text
    assert warc.page_of([("Content-Encoding", "gzip")], b"plain") == "plain" and warc.page_of([("Transfer-Encoding", "chunked")], b"zz\r\nplain") == "zz\r\nplain"


def test_pages_are_read_in_linear_time():
    import time

    for part in ("<title>", "<head>", "<!--", "<script>", "<a<", "<", "&#", "<a href=", "<svg><title>", "</title", "<p>x", "&#9" + "9" * 50):
        began = time.process_time()
        warc.read_page(part * 50_000)
        assert time.process_time() - began < 5, part
    assert warc.plain_text("&#" + "9" * 5000 + ";x &#x41;&amp;") == "\ufffdx A&"


def test_tool_calls(spark):
    schema = {"f": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}}}}
    calls = [(1, 5, "c", "f", '{"a": 2.0}', "b"), (1, 3, "b", "f", '{"a": -1, "z": 1}', "a"), (1, 4, "a", "g", "{}", None), (1, 4, "a", "g", "{}", None), (1, 9, "x", "f", "{bad", "y"), (1, 9, "y", "f", None, "x"), (2, 0, "a", "f", '{"a":1}', "gone"), (None, 1, "n", "f", "{}", None)]
    results = [(1, 6, "c", "ok"), (1, 7, "c", "late"), (3, 1, "lost", None)]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, parent string")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    out = {(x["conv_id"], x["call_id"]): x for x in toolcalls.link(c, r, schema).collect()}
    assert len(out) == 7
    assert [out[1, k]["depth"] for k in "abcxy"] == [0, 1, 2, None, None] and [out[1, k]["position"] for k in "abcxy"] == [0, 1, 2, 3, 4]
    assert [out[k]["status"] for k in ((1, "c"), (1, "a"), (3, "lost"))] == ["linked", "pending", "orphan"] and out[2, "a"]["depth"] == 0
    assert out[1, "b"]["problems"] == "$.a: too small; $.z: unknown" and out[1, "a"]["problems"] == "$: unknown tool" and out[1, "x"]["problems"] == "$: no JSON" and out[1, "c"]["valid"]
    assert out[1, "c"]["json"] == '{"arguments":{"a":2},"id":"c","name":"f","result":"ok","status":"linked"}'
    assert got(toolcalls.link(c.where("false"), r.where("false"), schema)) == []


def test_tool_calls_in_messages(spark):
    m = [(1, 0, '{"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 1}}]}'), (1, 1, '{"tool_call_id": "a", "content": {"y": 2}}'), (1, 2, "prose"), (1, 3, "{no"), (1, 4, None)]
    calls, results = toolcalls.extract(spark.createDataFrame(m, "conv_id long, turn long, text string"))
    assert got(calls.select("call_id", "name", "arguments")) == [("a", "f", '{"x":1}')] and got(results.select("call_id", "content")) == [("a", '{"y":2}')]


def test_messages_that_are_odd(spark):
    deep = "[" * 100_000 + "]" * 100_000
    texts = ['{"tool_calls": 5}', '{"tool_calls": [5, {"id": null}, {"name": "f"}, {"id": 7, "name": 8, "arguments": [1.50], "parent": {"b": 1, "a": 2}}]}', '{"tool_calls": [{"id": "d", "arguments": ' + deep + "}]}", '{"tool_calls": [{"id": "s", "arguments": {"a": "\\ud83d"}}]}', '{"tool_calls": [{"id": "n", "arguments": NaN}]}', '{"tool_calls": [{"id": "e", "arguments": 1e999}]}', "{", "[]", "{}", '{"tool_call_id": 7, "content": null}', " " * 10]
    calls, results = toolcalls.extract(spark.createDataFrame(list(enumerate(texts)), "turn long, text string").withColumn("conv_id", F.lit(None).cast("long")))
    assert got(calls.select("call_id", "name", "arguments", "parent")) == [("7", "8", "[1.5]", '{"a":2,"b":1}')]
    assert got(results.select("call_id", "content")) == [("7", None)]


def test_calls_with_odd_arguments(spark):
    schema = {"f": {"type": "object", "properties": {"a": {"enum": [True]}, "b": {"type": "date"}}}}
    given = {"deep": "[" * 5000, "half": '{"a":"\\ud83d"}', "one": '{"a":1}', "true": '{"a":true}', "date": '{"b":"x"}', "big": "1" * 5000, "nan": '{"a":NaN}'}
    calls = spark.createDataFrame([(1, None, k, "f", v, None) for k, v in given.items()] + [(1, 3, "one", "f", '{"a":true}', None)], "conv_id long, turn long, call_id string, name string, arguments string, parent string")
    out = {r["call_id"]: r for r in toolcalls.link(calls, spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), schema).collect()}
    assert [out[k]["problems"] for k in ("deep", "half", "big", "nan")] == ["$: no JSON"] * 4
    assert out["one"]["valid"] and out["one"]["turn"] == 3 and out["true"]["valid"] and out["date"]["problems"] == "$.b: not date"
    assert toolcalls.violations(1, {"enum": [True]}) == ["$: not one of the values"]


def test_canonical_json():
    for value, text in ((333333333.33333329, "333333333.3333333"), (1e30, "1e+30"), (4.50, "4.5"), (2e-3, "0.002"), (1e-27, "1e-27"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (-0.0, "0"), (1e-6, "0.000001"), (1e-7, "1e-7"), (10**20, "100000000000000000000"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (-12.0, "-12"), (123456.789, "123456.789"), (295147905179352830000, "295147905179352830000")):
        assert toolcalls.canonical(value) == text
    keys = {"\u20ac": 1, "\r": 2, "\ufb33": 3, "1": 4, "\U0001f600": 5, "\u0080": 6, "\u00f6": 7}
    assert list(json.loads(toolcalls.canonical(keys))) == ["\r", "1", "\u0080", "\u00f6", "\u20ac", "\U0001f600", "\ufb33"]
    assert toolcalls.canonical({"b": [None, True, "\u20ac$\x0f\nA'B\"\\\\\"/"]}) == '{"b":[null,true,"€$\\u000f\\nA\'B\\"\\\\\\\\\\"/"]}'


def test_real_calls_in_chats_are_linked(spark):
    turns = [(1, 0, "system", "x"), (1, 1, "user", '{"tool_calls": [{"id": "z", "name": "none", "arguments": {}}]}'), (1, 2, "assistant", "done"), (1, 3, "tool", '{"tool_call_id": "z", "content": "r"}')]
    out = {r["call_id"]: r for r in toolcalls.link(*toolcalls.extract(toolcalls.chat_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))), toolcalls.CHAT_TOOLS).collect()}
    assert set(out) == {"1", "z"} and out["z"]["status"] == "linked" and out["z"]["problems"] == "$: unknown tool" and out["1"]["valid"]


def test_long_chains_of_calls(spark):
    calls = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.col("id").cast("string").alias("call_id"), F.lit("f").alias("name"), F.lit("{}").alias("arguments"), (F.col("id") - 1).cast("string").alias("parent"))
    out = toolcalls.link(calls, spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), {"f": {}})
    assert out.where("depth <> turn or position <> turn").count() == 0 and out.count() == 300


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    for d, t in rows.items():
        n, _, _, _, again = brute.statistics(t)
        assert d not in kept or not (n < 20 or 100 * again > 30 * n)
    assert len(kept) > 0.7 * len(rows)
    first = docs.where(F.col("doc_id").isin(list(kept)))
    some = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_duplicates(spark, first, SF).collect()}
    assert sorted(some, key=str) == brute.near_duplicates_kept(sorted(kept.items()), 5, 0.8)
    second = docs.where(F.col("doc_id").isin(list(some)))
    cut = corpus_pipeline.repeated_passages(spark, second, SF)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    digests = {d: h for d, _, _, _, h in brute.removed(sorted(some.items()), 200)}
    for r in cut.collect():
        assert r["n_chars"] == len(r["text"])
        assert "�" in r["text"] or hashlib.sha256(r["text"].encode()).hexdigest() == digests[r["doc_id"]] or len(r["text"]) < len(some[r["doc_id"]])
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(some)


def test_registered():
    names = set(queries.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and set(queries.oracle_sql()) <= names


def test_results_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        theirs = con.execute(sql)
        order = [[c[0] for c in theirs.description].index(c) for c in df.columns]
        assert want([tuple(map(str, r)) for r in df.collect()]) == want([tuple(str(r[i]) for i in order) for r in theirs.fetchall()])
