"""Operators on documents against brute force, and their defined results in edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vicinity.llm import exact, packing, pieces, repair, sharding, simhash, words
from vicinity.llm.common import workspace
from vicinity.llm.fingerprints import majority, shingle_hashes

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

LONG = "omega \n psi, " * 20_000
#: Columns whose names the operators use themselves.
CLASH = "row string, digest string, n string, key string, block string, piece string, fp string, shard string"
EDGES = [
    (1, "one two three four five six"),
    (2, "one two three four five six"),
    (2, "one two three four five six"),
    (3, None),
    (4, ""),
    (None, "no name"),
    (None, None),
    (5, " \t\n "),
    (6, LONG),
    (7, "ÀÉ 日本語 😀 \u0000 x  y"),
]


@pytest.fixture
def edges(table):
    names = [c.split()[0] for c in CLASH.split(", ")]
    return table(f"doc_id bigint, text string, {CLASH}", *[(*r, *names) for r in EDGES])


@pytest.fixture
def nothing(table):
    return table(f"doc_id bigint, text string, {CLASH}")


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path, word_ends", [(BYTES, False), (WORDS, True)])
def test_special_tokens_in_a_text_are_the_librarys(path, word_ends):
    plain = Tokenizer.from_file(path)
    texts = [
        f"{a}{mark}{b}"
        for mark in ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|><|endoftext|>", "<|endoftext|><|endoftext|>")
        for a in ("", "a ", "A", "word  ", "x.\n", "Σ ", "<|")
        for b in ("", " b", "B", ".", "  y", "\tz", "|>", "\u0338", " <|endoftext|>.")
    ]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode_bytes(texts, path, word_ends, special=True)] == want


def test_packed_and_written_ids_hold_special_tokens(spark, table):
    texts = {1: "a <|endoftext|> b", 2: "A<|endoftext|>b<|startoftext|>", 3: "<|ENDOFTEXT|>"}
    docs = table("doc_id bigint, text string", *texts.items())
    path = f"{workspace(spark)}/tokens"
    repair.write_tokens(docs, path, WORDS, 49408)
    packed, written = packing.pack(docs, BYTES).collect(), repair.read_tokens(spark, path).collect()
    for rows, file, size in ((packed, BYTES, "length"), (written, WORDS, "n_tokens")):
        plain = Tokenizer.from_file(file)
        want = {k: len(plain.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
        assert {r.doc_id: r[size] for r in rows} == want
    assert "ids" in written[0].asDict() and np.frombuffer({r.doc_id: r.ids for r in written}[1], "<u4").tolist() == [320, 49407, 321, 2]


# --- exact ---------------------------------------------------------------------------------


def brute_groups(rows):
    groups = defaultdict(list)
    for name, text in rows:
        groups[text or ""].append(name)
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_matches_grouping_by_text(edges, weak):
    digest = (lambda t: F.encode(F.substring(t, 1, 1), "utf-8")) if weak else exact.sha256
    got = exact.deduplicate(edges, digest=digest).collect()
    groups = brute_groups(EDGES)
    assert len(got) == len(EDGES)
    want = Counter()
    for names in groups.values():
        known = [n for n in names if n is not None]
        want.update((n, max(known, default=None), len(names)) for n in names)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_goes_on_from_its_state(spark, table):
    folder = workspace(spark)
    first = table("doc_id bigint, text string", (1, "a"), (2, "b"))
    exact.digests(first).write.parquet(f"{folder}/feed")
    exact.update_state(spark, folder, batch_bytes=1)
    exact.digests(table("doc_id bigint, text string", (3, "a"), (4, "c"))).write.mode("append").parquet(
        f"{folder}/feed"
    )
    exact.update_state(spark, folder, batch_bytes=1)
    state = {bytes(r.digest).hex(): (r.keep_id, r.group_size) for r in exact.read_state(spark, folder).collect()}
    want = {"a": (3, 2), "b": (2, 1), "c": (4, 1)}
    assert state == {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}


def test_exact_keeps_one_row_with_all_columns(edges):
    kept = exact.keep_latest(edges)
    assert kept.columns == edges.columns
    assert Counter((r.text or "") for r in kept.collect()) == Counter(brute_groups(EDGES).keys())


# --- SimHash -------------------------------------------------------------------------------


def brute_components(rows):
    prints = [majority(shingle_hashes(t)) & (2**64 - 1) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.MAX_BITS:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        least[find(i)] += [name] if name is not None else []
    return [(n, f"{p:016x}", min(least[find(i)], default=None)) for i, ((n, _), p) in enumerate(zip(rows, prints))]


def near_copies(seed, groups, copies, length=120):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, length)]
        for c in range(copies):
            text = list(base)
            for _ in range(int(rng.integers(0, 3))):
                text[int(rng.integers(0, length))] = f"v{int(rng.integers(0, 99))}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_bits_are_set_by_over_half_of_the_hashes():
    assert majority([0b11, 0b01]) == 0b01
    assert majority([1 << 63]) == -(1 << 63)
    assert majority([]) == 0
    assert shingle_hashes("A  b\tC") == shingle_hashes("a b c") and len(shingle_hashes("a b c d e")) == 2


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_simhash_matches_all_pairs(table, block):
    rows = near_copies(3, 12, 25) + [(1000 + i, t) for i, (_, t) in enumerate(EDGES[:9])]
    got = simhash.near_duplicates(table("doc_id bigint, text string", *rows), block=block).collect()
    want = brute_components(rows)
    assert len({w[2] for w in want}) < len(rows) - 100
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter(want)


def test_simhash_edges(edges, nothing):
    got = simhash.near_duplicates(edges).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter(brute_components(EDGES))
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_first(edges)
    assert kept.columns == edges.columns
    first = {w[2] for w in brute_components(EDGES)}
    assert {r.doc_id for r in kept.collect()} == first | {None}


def test_simhash_broadcasts_no_balls(spark, table):
    prints = table("fp bigint", *[((i * 0x9E3779B97F4A7C15) % (1 << 63),) for i in range(300)])
    plan = simhash.links(prints, workspace(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftAnti" not in x]


# --- sharding ------------------------------------------------------------------------------


def test_shards_have_near_equal_bytes_and_gapless_slots(table):
    rng = np.random.default_rng(5)
    rows = [(i, "x" * int(rng.integers(0, 3000))) for i in range(3000)]
    rows += [(5000 + i, "one text that a third of all rows share") for i in range(1500)]
    got = sharding.shard_documents(table("doc_id bigint, text string", *rows)).collect()
    size, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    texts = dict(rows)
    for r in got:
        of_text[texts[r.doc_id]].add(r.shard)
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert len(got) == len(rows) and set(size) == set(range(8))
    assert max(size.values()) < 1.03 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_an_overfull_range_is_divided(table):
    text = "y" * 500
    got = sharding.shard_documents(table("doc_id bigint, text string", *[(i, text) for i in range(4000)])).collect()
    size = Counter(r.shard for r in got)
    assert len(size) == 8 and max(size.values()) < 1.1 * min(size.values())


def test_shard_edges(spark, edges, nothing, tmp_path):
    got = sharding.shard_documents(edges).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter(
        (n, len((t or "").encode()) + 1) for n, t in EDGES
    )
    assert sharding.shard_documents(nothing).count() == 0
    sharding.write_shards(edges, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.text for r in back.collect()) == Counter(t for _, t in EDGES)


# --- tokens --------------------------------------------------------------------------------

ODD = [
    "", " ", "  ", "a  b", "a \n b", " lead", "trail ", "x\n", "a\x00 b", "don't 's  'll", "café \x1c b", "\x1d",
    "ΑΣ Σ.", "a　b   c", "<|endoftext|> hi", "İI.", "é ́x", "1234 56, 7.", "한국어 👍🏽x", "​q w.,",
]


def mixed(seed, count):
    rng = np.random.default_rng(seed)
    letters = list(" \n\taé's1.,\x1c\x85　́A\x00日😀Σ▁ethion")
    return ["".join(rng.choice(letters, int(rng.integers(1, 50)))) for _ in range(count)]


@pytest.mark.parametrize("path, word_ends", [(BYTES, False), (WORDS, True)])
def test_cached_ids_are_the_librarys(path, word_ends):
    texts = [*ODD, *mixed(1, 1500), LONG[:5000]]
    want = library(path)
    for text, got in zip(texts, words.encode_bytes(texts, path, word_ends)):
        assert np.frombuffer(got, "<u4").tolist() == want(text), repr(text)


def test_a_small_cache_gives_the_same():
    texts = mixed(2, 200)
    cache = words.PieceCache(lambda new: [w.upper() for w in new], generation=5)
    for text in texts:
        assert {w: cache.values(text.split())[w] for w in text.split()} == {w: w.upper() for w in text.split()}


def test_prefix_table_is_the_librarys_encoding():
    model = pieces._model(PIECES)[0]
    texts = [*ODD, " " * 40 + "x", "a" * 50, "▁x  y▁ z", "--------------------------", *mixed(3, 1500), LONG[:5000]]
    for text, (ids, line) in zip(texts, pieces.encode_texts(texts, PIECES)):
        assert ids == model.encode(text), repr(text)
        assert line == ",".join(map(str, ids))


def test_round_trip_edges(edges, nothing):
    model = pieces._model(PIECES)[0]
    got = pieces.round_trip(edges, PIECES).collect()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for name, text in EDGES:
        ids = model.encode(text or "")
        want.append((name, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert Counter(map(tuple, got)) == Counter(want)
    assert pieces.round_trip(nothing, PIECES).count() == 0
    assert pieces.encode_documents(edges, PIECES).count() == len(EDGES)


# --- packing -------------------------------------------------------------------------------


def test_fullest_is_the_largest_sum():
    rng = np.random.default_rng(8)
    for _ in range(200):
        lengths = sorted(rng.integers(1, 30, int(rng.integers(1, 9))).tolist(), reverse=True)
        counts, room = dict(Counter(lengths)), int(rng.integers(1, 60))
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums if s + x <= room}
        chosen = packing.fullest(counts, room)
        assert sum(k * n for k, n in chosen.items()) == max(sums)
        assert all(n <= counts[k] for k, n in chosen.items())


def test_cut_leaves_the_rest_first():
    assert packing.cut(1) == [(0, 1)]
    assert packing.cut(1024) == [(0, 1024)]
    assert packing.cut(2050) == [(0, 2), (2, 1024), (1026, 1024)]


def check_packing(rows, got, tokenize, capacity):
    ids = {}
    for k, (name, text) in enumerate(rows):
        ids.setdefault((name, text), [*tokenize(text), packing.END_ID])
    want = Counter()
    for name, text in rows:
        one = ids[name, text]
        for piece, (start, length) in enumerate(packing.cut(len(one), capacity)):
            crc = zlib.crc32(np.array(one[start : start + length], "<u4").tobytes())
            want[name, piece, start, length, crc] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in got)


@pytest.mark.parametrize("block", [packing.BLOCK, 50])
def test_packing_is_whole_and_tight(table, block):
    rng = np.random.default_rng(4)
    rows = [(i, "tree " * int(rng.integers(0, 150))) for i in range(600)]
    docs = table("doc_id bigint, text string", *rows).repartition(3)
    bins, total = check_packing(rows, packing.pack(docs, BYTES, 128, block).collect(), library(BYTES), 128)
    assert bins <= -(-total // 128) + (1 if block > 600 else 14)


def test_packing_edges(edges, nothing):
    check_packing(EDGES, packing.pack(edges, BYTES).collect(), library(BYTES), 1024)
    assert packing.pack(nothing, BYTES).count() == 0


# --- token files ---------------------------------------------------------------------------


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(6)
    docs = [(k, rng.integers(0, 7, int(rng.integers(1, 400))).astype("<u4").tobytes()) for k in range(80)]
    docs.append((80, np.zeros(3001, "<u4").tobytes()))
    row = repair.to_shard(docs, 7)
    shard = repair.Shard(row)
    assert len(shard.symbols) < sum(row["doc_tokens"]) / 2
    assert len(shard.symbols[shard.begin[80] :]) < 120
    assert shard.ids().astype("<u4").tobytes() == b"".join(ids for _, ids in docs)
    for k, (_, ids) in enumerate(docs):
        whole = np.frombuffer(ids, "<u4")
        assert (shard.document(k) == whole).all()
        for _ in range(5):
            a, b = sorted(rng.integers(0, len(whole) + 2, 2).tolist())
            assert (shard.document(k, a, b) == whole[a:b]).all()


def test_places_never_overlap_and_take_the_better_rank():
    at, ranks = np.array([0, 1, 2, 3, 7, 8]), np.array([1, 0, 2, 2, 3, 3])
    keep = repair.apart(at, ranks)
    assert at[keep].tolist() == [1, 3, 7] or at[keep].tolist() == [1, 7]
    run = repair.apart(np.arange(5), np.zeros(5, dtype=int))
    assert run.tolist() == [True, False, True, False, True]


@pytest.mark.parametrize("shard_ids", [repair.SHARD_IDS, 40])
def test_token_files_edges(spark, edges, nothing, shard_ids):
    folder, tokenize = workspace(spark), library(WORDS)
    repair.write_tokens(edges, f"{folder}/tokens", WORDS, 49408, shard_ids)
    got = sorted(repair.read_tokens(spark, f"{folder}/tokens").collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    names = [r.doc_id for r in got]
    assert names == sorted(names, key=lambda n: (n is not None, n))
    want = Counter((n, np.array([*tokenize(t), 2], "<u4").tobytes()) for n, t in EDGES)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    repair.write_tokens(nothing, f"{folder}/none", WORDS, 49408)
    assert repair.read_tokens(spark, f"{folder}/none").count() == 0


# --- Re-Pair until nothing is left ---------------------------------------------------------


def frequent_left(ids, last, vocabulary, least):
    grammar, symbols, last = repair.re_pair(ids, last, vocabulary, least)
    pairs = Counter(zip(symbols[:-1][~last[:-1]].tolist(), symbols[1:][~last[:-1]].tolist()))
    flat, at = grammar.expansions()
    assert np.concatenate([flat[at[s] : at[s + 1]] for s in symbols]).tolist() == ids.tolist()
    return grammar, symbols, [p for p, n in pairs.items() if n >= least]


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(7)
    passage = rng.integers(0, 40_000, 300)
    ids = np.concatenate([np.r_[passage, rng.integers(0, 40_000, 5)] for _ in range(40)])
    last = np.zeros(len(ids), dtype=bool)
    last[-1] = True
    grammar, symbols, left = frequent_left(ids, last, 40_000, 12)
    assert not left and grammar.lengths.max() == 300


def test_pairs_that_share_a_slot_are_all_replaced():
    number = lambda a, b: ((a << 16 | b) * 2654435761 & 0xFFFFFFFF) >> 12
    seen = {}
    pair = next((seen[s], (a, b)) for a in range(1, 9000, 2) for b in range(2, 900, 2)
                if (s := number(a, b)) in seen and not set(seen[s]) & {a, b} or seen.setdefault(s, (a, b)) is None)
    (a, b), (c, d) = pair
    ids = np.array([a, b] * 14 + [c, d] * 3)
    last = np.arange(len(ids)) % 2 == 1
    _, _, left = frequent_left(ids, last, 9000, 12)
    assert number(a, b) == number(c, d) and not left


def test_too_large_vocabularies_are_refused(table):
    with pytest.raises(ValueError):
        repair.write_tokens(table("doc_id bigint, text string", (1, "a")), "unused", WORDS, repair.SYMBOLS + 1)
    with pytest.raises(ValueError):
        repair.re_pair(np.array([1, 70_000]), np.array([False, True]), 70_001)


def test_shards_keep_columns_of_any_name(spark, tmp_path):
    names = ("_id", "_size", "_h", "_row", "_n", "_shard", "_whole", "a.b", "Shard")
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 90).alias("text"),
        *(F.concat(F.lit(f"{n} "), "id").alias(n) for n in names))
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.doc_id for r in got) == list(range(300)) and {r.shard for r in got} == set(range(4))
    assert all(r[n] == f"{n} {r.doc_id}" for r in got for n in names if n != "Shard")
