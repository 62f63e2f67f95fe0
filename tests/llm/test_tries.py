import hashlib
import random
import zlib

import pytest

from contactmill.llm import tries


def brute(told):
    """Nodes by direct definition; ``told`` maps a lead to its list of (type, body)."""
    nodes = {}
    for lead, turns in told.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(lead)
    out = []
    for path, leads in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        ends = ",".join(str(i) for i in sorted(i for i in leads if len(told[i]) == len(path)))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p)
        out.append((min(leads), len(path), min(nodes[path[:-1]]) if path else None, len(leads), sum(len(p) == len(path) + 1 for p in under),
                    len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def shared(told):
    out = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = told.get(c - c % 100, [])[:h] + own[h:]
    return out


def rows_of(told):
    return [(lead, at, kind, body) for lead, turns in told.items() for at, (kind, body) in enumerate(turns)]


def run(spark, rows, opened=False, schema="lead_id long, id long, type string, body string", **given):
    turns = tries.turn_ids(spark.createDataFrame(rows, schema))
    turns = tries.share_openings(turns) if opened else turns
    return sorted((tuple(r) for r in tries.prefix_tree(turns, **given).collect()), key=repr)


def invented(seed, leads=150, longest=9):
    rng = random.Random(seed)
    return {i: [(rng.choice("ab"), rng.choice(["", "x", "yy"])) for _ in range(rng.randrange(1, longest))] for i in range(leads)}


@pytest.fixture
def many_parts(spark):
    """Small sorted partitions stay apart, so that nodes are shared by neighbouring tasks."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, False)
    yield
    spark.conf.unset(key)


@pytest.mark.parametrize("piece_turns,tree_rows", [(1, 5), (3, 5), (3, 50_000), (512, 5), (512, 50_000)])
def test_like_brute_force(spark, many_parts, piece_turns, tree_rows):
    """Also with conversations cut into pieces and strings dealt over many stretches."""
    told = invented(piece_turns) | {200 + i: [("a", "x")] * 4 for i in range(40)} | {300: [("a", "x")] * 30, 301: [("a", "x")] * 29 + [("b", "q")]}
    assert run(spark, rows_of(told), piece_turns=piece_turns, tree_rows=tree_rows) == brute(told)


def test_shared_openings(spark):
    told = {i: t for i, t in invented(7, 260).items() if i != 100}
    assert run(spark, rows_of(told), opened=True) == brute(shared(told))


def test_odd_rows(spark):
    """Null order, type, body and lead, repeated rows, empty bodies, further columns, no rows."""
    rows = [(1, None, None, None), (1, 5, "u", "a"), (1, 5, "u", "a"), (2, 7, None, ""), (None, 1, "u", "a"), (3, 2, "u", "long " * 50_000)]
    told = {1: [("", ""), ("u", "a"), ("u", "a")], 2: [("", "")], 3: [("u", "long " * 50_000)]}
    assert run(spark, rows) == brute(told)
    wide = [(*r, b"x", "n") for r in rows]
    assert run(spark, wide, schema="lead_id long, id long, type string, body string, key binary, node string") == brute(told)
    assert run(spark, []) == [] and run(spark, [], opened=True) == []


def stretches(strings, cut):
    """Rows of neighbouring stretches of sorted (key, lead) strings, as the tasks make them."""
    strings, out = sorted(strings), []
    parts = [strings[a:b] for a, b in zip([0, *cut], [*cut, len(strings)]) if a < b]
    for no, part in enumerate(parts):
        stretch = tries.Stretch(no, parts[no - 1][-1][0] if no else b"", 512)
        for key, lead in part:
            n = len(key) // tries.WIDTH - 1
            stretch.add(key, lead, 0, True, b"\x01\0\0\0\0\0\0\0" * n, (0, 0))
        out += stretch.close(parts[no + 1][0][0] if no + 1 < len(parts) else b"")
    return out


@pytest.mark.parametrize("seed", range(40))
def test_any_cut_gives_the_same_nodes(seed):
    """What stretches add to a node is the same sum wherever the strings are cut."""
    rng = random.Random(seed)
    ids = [bytes([b]) * 16 for b in (1, 2, 3)]
    strings = [(tries.ROOT + b"".join(rng.choice(ids) for _ in range(rng.randrange(0, 5))), i) for i in range(40)]

    def totals(rows):
        out = {}
        for r in rows:
            key = r[1] or (r[3], r[5])
            old = out.get(key, (None, 0, 0, 0, 0))
            out[key] = (min(x for x in (old[0], r[3]) if x is not None), *[a + b for a, b in zip(old[1:], r[6:10])])
        return sorted(out.values())

    assert totals(stretches(strings, [])) == totals(stretches(strings, sorted(rng.sample(range(1, 40), rng.randrange(1, 12)))))


def test_radix_layouts_grow():
    """Strings that are beginnings of others, splits inside a path, and 256 children of one node."""
    keys = [b"", b"ab", b"abc", b"abd", b"xyz"] + [b"k" + bytes([b]) for b in range(256)] + [b"k" + bytes([b]) * 40 for b in range(0, 256, 5)]
    tree = tries.RadixTree(list)
    for n, key in enumerate(keys):
        tree.end_of(key).append(n)
    assert [tree.end_of(key) for key in keys] == [[n] for n in range(len(keys))]
    kinds = {type(node.kids) for node, _, _ in tree.top_down()}
    assert kinds >= {tries.Few, tries.All} and max(above + len(node.path) for node, above, _ in tree.top_down()) == 41
    layout = tries.Few()
    for n, byte in enumerate(random.Random(1).sample(range(256), 256), 1):
        layout = layout.put(byte, byte)
        assert type(layout) is (tries.Few if n <= 16 else tries.Some if n <= 48 else tries.All) and layout.get(byte) == byte
        assert sorted(b for b, _ in layout.items()) == sorted(b for _, b in layout.items())
