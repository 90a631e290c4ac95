"""Vectors, components and quotations against brute force and SQL."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from vicinity.llm import embeddings, quotations
from vicinity.llm.common import attach, components, store, workspace
from vicinity.llm.queries import ORACLES


def brute_vectors(rows):
    """n_links and component of each row, by all pairs in double precision."""
    usable = []
    for i, (name, v) in enumerate(rows):
        x = np.array(v, dtype=float) if v and None not in v else np.zeros(1)
        if name is not None and np.isfinite(x).all() and x.any():
            usable.append((i, x / np.linalg.norm(x)))
    near = defaultdict(set)
    for i, x in usable:
        for j, y in usable:
            if i != j and len(x) == len(y) and x @ y >= embeddings.THRESHOLD:
                near[i].add(j)
    out = []
    for i, (name, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            new = near[queue.pop()] - seen
            seen |= new
            queue += new
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((name, len(near[i]), min(names, default=None)))
    return out


def vectors(seed):
    rng, rows = np.random.default_rng(seed), []
    for k in range(40):
        base = rng.normal(size=16)
        for _ in range(1 if k % 3 else 9):
            rows.append(base + rng.normal(size=16) * 0.12)
    crowd = rng.normal(size=16)
    rows += [crowd + rng.normal(size=16) * 0.03 for _ in range(120)]
    rows += [rows[0], rows[0], 3 * rows[1], -rows[2]]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


ODD = [
    (900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] + [0.0] * 14), (904, [float("nan")] * 16),
    (905, [float("inf")] * 16), (None, [1.0] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e-30] * 16),
    (909, [1e30] * 16), (910, [0.5] * 16), (910, [0.5] * 16),
]


@pytest.mark.parametrize("block, held", [(embeddings.BLOCK, embeddings.HELD), (10, 50)])
def test_vectors_match_all_pairs(table, block, held):
    rows = vectors(2) + ODD
    frame = table("vec_id bigint, embedding array<float>, node string, key string", *[(*r, "a", "b") for r in rows])
    got = embeddings.near_duplicates(frame, block=block, held=held).collect()
    want = brute_vectors(rows)
    links, found = sum(w[1] for w in want), sum(r.n_links for r in got)
    assert len(got) == len(rows) and found <= links and found >= 0.95 * links
    exact = Counter((r.vec_id, r.n_links, r.component_id) for r in got) & Counter(want)
    assert sum(exact.values()) >= 0.95 * len(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    odd = {w for w in want if w[0] is None or w[0] >= 900}
    assert odd == {(r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is None or r.vec_id >= 900}


def test_no_vectors(table):
    frame = table("vec_id bigint, embedding array<float>")
    assert embeddings.near_duplicates(frame).count() == 0
    assert embeddings.near_duplicates(table("vec_id bigint, embedding array<float>", (1, None))).collect()[0].kept


def narrow_cone(seed, n, width, cosine):
    """Vectors around one direction, a third of them near-copies of others."""
    rng = np.random.default_rng(seed)
    rows = np.sqrt(cosine) * np.eye(width)[0] + rng.normal(size=(n, width)) * np.sqrt((1 - cosine) / width)
    rows[: n // 3] = rows[-(n // 3) :] + rng.normal(size=(n // 3, width)) * 0.3 / np.sqrt(width)
    return [(i, v.tolist()) for i, v in enumerate(rows)]


@pytest.mark.parametrize("rows, block", [
    ([(1, [1.0, 0.0]), (2, [0.99, 0.1])], embeddings.BLOCK),
    (narrow_cone(5, 300, 256, 0.85), 40),
])
def test_vectors_around_one_reference_point(table, rows, block):
    frame = table("vec_id bigint, embedding array<double>", *rows)
    got = embeddings.near_duplicates(frame, block=block).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(brute_vectors(rows))


def test_forest_keeps_components():
    rng = np.random.default_rng(4)
    near = rng.random((30, 30)) < 0.06
    near |= near.T
    links = embeddings.forest(near)
    assert len(links) < 60 and all(near[i, j] for i, j in links)

    def groups(pairs):
        root = list(range(30))
        for _ in range(30):
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert groups(links) == groups(list(zip(*np.nonzero(near))))


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 200)],
    [(5, 3), (3, 5), (3, 3), (9, 7), (7, 8), (-4, -9)],
    [],
])
def test_components(spark, table, edges):
    got = {r.node: r.root for r in components(table("a bigint, b bigint", *edges), workspace(spark)).collect()}
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_attach_finds_heavy_and_light_keys(spark, table):
    left = [(k % 7 if k % 3 else 0, k) for k in range(300)]
    count = Counter(k for k, _ in left)
    left = store(table("key bigint, v bigint", *left), workspace(spark), "left")
    right = table("key bigint, n bigint, w bigint", *[(k, n, k * 10) for k, n in count.items() if k != 6])
    got = attach(left, right, "key", "n", 300, parts=10).collect()
    assert len(got) == 300 - count[6] and all(r.w == r.key * 10 for r in got)


# --- quotations ----------------------------------------------------------------------------

MAIL = [
    (1, 0, "user", "Where is the station?\n\nPlease answer soon today."),
    (1, 1, "assistant", "> Where is  the STATION?\nIt is next to the river bank."),
    (1, 2, "user", ">> Where is the station?\n> It is next to the river bank.\n\nThank you for the answer."),
    (1, 3, "user", "Something else entirely here."),
    (1, 4, "assistant", "> never written by anyone\n> on two lines\nNo idea about that one."),
    (2, 0, "user", "> It is next to the river bank.\r\nSays another conversation."),
    (2, 1, "user", "> ok\nToo short to link."),
    (2, 2, "user", None),
    (2, 3, "user", ""),
    (2, 4, "user", " > > deep marks of nobody\n>\n > Says another conversation.\nLast words of it."),
    (3, 0, "user", "> Last words of it.\n> Last words of it.\nLast words of it."),
    (3, 0, "user", "a repeated turn of three"),
]


def test_quotations_match_sql(table):
    frame = table("conv_id bigint, turn bigint, role string, text string, row string, place string",
                  *[(*m, "x", "y") for m in MAIL])
    got = quotations.link_quotations(frame)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", MAIL[:-1])
    result = db.execute(ORACLES["op5_quotation_linking"])
    names = [c[0] for c in result.description]
    want = Counter(tuple(sorted(zip(names, r))) for r in result.fetchall())
    rows = [r.asDict() for r in got.collect()]
    assert len(rows) == len(MAIL)
    repeat = [r for r in rows if r["own_text"] == "a repeated turn of three"]
    have = Counter(tuple(sorted(r.items())) for r in rows if r not in repeat)
    assert have == want
    by = {(r["conv_id"], r["turn"]): r for r in rows if r not in repeat}
    assert by[1, 1]["parent_turn"] == 0 and by[1, 2]["parent_turn"] == 1 and by[1, 2]["root_turn"] == 0
    assert by[1, 2]["depth"] == 2 and by[1, 2]["own_text"] == "Thank you for the answer."
    assert (by[2, 0]["parent_conv"], by[2, 0]["parent_turn"]) == (1, 1)
    assert by[2, 4]["parent_turn"] == 0 and by[2, 4]["quotes"] == 2


def test_short_quotations_link_within_their_conversation(table):
    said = ["I agree.", "ok", "好的", "\U0001f44d", "x"]
    rows = [(1, 0, "user", "Thanks!"), (3, 0, "user", "> Thanks!\nnot from here"), (3, 1, "user", "> ok\nnor this")]
    rows += [(2, 2 * k, "user", text) for k, text in enumerate(said)]
    rows += [(2, 2 * k + 1, "user", f"> {text.upper()}\nreply to {k} of them") for k, text in enumerate(said)]
    rows += [(2, 20, "user", "> reply to 1 of them\n>> OK\n\nthe last of them")]
    frame = table("conv_id bigint, turn bigint, role string, text string", *rows)
    got = {(r.conv_id, r.turn): r for r in quotations.link_quotations(frame).collect()}
    for k in range(len(said)):
        r = got[2, 2 * k + 1]
        assert (r.linked, r.parent_conv, r.parent_turn, r.root_turn, r.depth) == (1, 2, 2 * k, 2 * k, 1)
    assert (got[2, 20].linked, got[2, 20].parent_turn, got[2, 20].root_turn, got[2, 20].depth) == (2, 3, 2, 2)
    assert all(got[3, t].linked == 0 and got[3, t].parent_conv is None for t in (0, 1))


def test_quotation_edges(table):
    ddl = "conv_id bigint, turn bigint, role string, text string"
    assert quotations.link_quotations(table(ddl)).count() == 0
    rows = [(None, 0, "user", "> quoted by nobody\nown"), (1, None, "user", "own"), (1, 1, None, "> own words of a row\n" * 500)]
    got = {(r.conv_id, r.turn): r for r in quotations.link_quotations(table(ddl, *rows)).collect()}
    assert len(got) == 3 and got[1, 1].quotes == 1 and got[1, 1].own_text == ""
    assert {r.position for r in got.values()} == {0, 1}
    crowd = [(7, t, "user", f"> message number {t - 1} of all\nmessage number {t} of all") for t in range(130)]
    deep = quotations.link_quotations(table(ddl, *crowd)).collect()
    assert all(r.depth == r.turn and r.root_turn == 0 and r.position == r.turn for r in deep)
