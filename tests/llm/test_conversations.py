"""The prefix trie against a plain one in Python, on odd rows and with small blocks and lists."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tesserae.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def odd_rows(seed=5):
    rng = random.Random(seed)
    text = lambda: rng.choice(("", None, "a", "b", "é😀", " ", "x" * 70 + rng.choice("12")))
    rows = []
    for conv in [*range(0, 24), *range(100, 160), 305, 307, -1, -250, 4_000_000_000, 4_000_000_001]:
        for turn in range(rng.choice((0, 1, 2, 3, 9))):
            rows.append((conv, rng.choice((turn, turn, None, 3)), rng.choice(("user", "user", None, "bot")), text()))
    rows += [(conv, t, "user", f"same {t}") for conv in range(200, 260) for t in range(4)]
    rows += [(260, t, "user", f"long {t % 3}") for t in range(300)]
    rows += [(None, 0, "user", "nobody"), (None, 1, None, None), rows[3], rows[3], rows[40]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    odd = "d x y n b h pos role2 px py base size weight total parent before row digest".split()
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'z' AS `{c}`" for c in odd]).repartition(3)


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, text[:64], hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(r, t) for *_, r, _, _, t in sorted(v)] for c, v in own.items()}
    members = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6 if rebuild else 0
        base = conv - int(abs(conv) % 100) * (1 if conv >= 0 else -1)
        members[conv] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for conv, turns in members.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(conv)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, convs in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(convs) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(members[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(path), parent, len(convs), kids[path], leaves[path], saved[path], digest))
    return out


def plain(df):
    key = lambda r: tuple(str(v) for v in r)
    return sorted((tuple(r) for r in df.collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(str(v) for v in r))


@pytest.mark.parametrize("seed", [5, 6])
def test_rebuilt_trie_equals_brute_force(spark, seed):
    rows = odd_rows(seed)
    assert plain(C.trie(C.rebuilt(C.turns(frame(spark, rows))))) == ordered(brute(rows))


def test_own_sequences_equal_brute_force(spark):
    rows = odd_rows(7)
    assert plain(C.trie(C.sequences(C.turns(frame(spark, rows))))) == ordered(brute(rows, rebuild=False))


def test_prefix_keys_do_not_depend_on_blocks(spark):
    rows = C.sequences(C.turns(frame(spark, odd_rows())))
    assert plain(C.prefixes(rows, block=4)) == plain(C.prefixes(rows))


def test_lists_of_ids_are_joined_across_parts(spark):
    rows = spark.createDataFrame([(i, 0, 0, 0) for i in range(1, 3000, 7)] + [(5, 1, 2, 3)], "conv_id bigint, d bigint, x bigint, y bigint")
    found = {tuple(r)[:3]: r.ends_sha256 for r in C.end_digests(rows, size=16).collect()}
    want = hashlib.sha256(",".join(map(str, range(1, 3000, 7))).encode()).hexdigest()
    assert found == {(0, 0, 0): want, (1, 2, 3): hashlib.sha256(b"5").hexdigest()}


def test_empty_table_has_no_nodes(spark):
    assert C.trie(C.rebuilt(C.turns(frame(spark, [])))).collect() == []


def test_only_turnless_conversations(spark):
    # Conversation 2 has h = 5 and no first conversation, so all its turns go.
    rows = [(2, t, "user", "a") for t in range(zlib.crc32(b"2") % 6)]
    found = C.trie(C.rebuilt(C.turns(frame(spark, rows)))).collect()
    assert [tuple(r) for r in found] == brute(rows) and len(found) == 1
