from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from skysieve.llm.prefix_trie import RESULT, WIDTH, Node, prefix_trie, radix_tree, share_openings, turn_sequences

SCHEMA = "conv_id long, turn long, role string, text string, ids int, sizes int, h int, node int"


def token(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:WIDTH]


def originals(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found[c].append((turn is not None, turn or 0, token(role, text), (role, text)))
    return {c: [t[3] for t in sorted(turns)] for c, turns in found.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    out = []
    for path, who in members.items():
        under = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        leaves = sum(not kids[p] for p in under)
        out.append((min(who), len(path), parent, len(who), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(parts)


def trie(spark, rows, batch, shared=True, parts=4):
    sequences = turn_sequences(frame(spark, rows))
    sequences = share_openings(sequences) if shared else sequences
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie(sequences.repartition(parts), batch)
        assert tuple(got.columns) == RESULT
        return sorted(map(tuple, got.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def talks(n, seed, words=3, longest=6):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(["user", "assistant"][:1]), rng.choice("aäb")[: rng.randint(0, 1)] * rng.randint(1, words))
        for c in range(n)
        for t in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize("batch", [1, 2, 7, 1000])
def test_plain_sequences_against_brute_force(spark, batch):
    rows = talks(60, batch)
    assert trie(spark, rows, batch, shared=False) == brute(originals(rows))


@pytest.mark.parametrize("batch", [3, 1000])
def test_shared_openings_against_brute_force(spark, batch):
    rows = [(c + 3, t, role, f"{text}{c % 4}") for c, t, role, text in talks(90, 11, longest=9)]
    assert trie(spark, rows, batch) == brute(rebuilt(originals(rows)))


def test_one_conversation_in_a_third_of_all_and_one_first_turn_in_the_rest(spark):
    hot = [(c, t, "user", "same") for c in range(40) for t in range(3)]
    rest = [(100 + c, t, "user", "same" if t == 0 else f"{c}-{t}") for c in range(80) for t in range(3)]
    rows = hot + rest + [(300, 0, "user", "other")]
    assert trie(spark, rows, 8, shared=False, parts=9) == brute(originals(rows))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "nobody"), (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 2, "user", ""),
        (2, 5, "", ""), (2, 5, "user", "ü" * 10), (7, 1, "a", "bc"), (8, 1, "ab", "c"), (9, 0, "user", "long " * 100_000),
        (-4, 0, "user", "x"), (2**62, 0, "user", "x"), (11, None, None, None), (12, 3, None, ""),
    ]
    for batch in (1, 1000):
        assert trie(spark, rows, batch, shared=False) == brute(originals(rows))
    positive = [r for r in rows if r[0] is None or r[0] >= 0]  # c - c % 5 has one meaning only from zero on
    assert trie(spark, positive, 4) == brute(rebuilt(originals(positive)))


def test_a_long_conversation_and_its_openings(spark):
    rows = [(c, t, "user", f"turn {t}") for c, n in ((1, 700), (2, 350), (3, 700)) for t in range(n)]
    assert trie(spark, rows, 1, shared=False) == brute(originals(rows))


def test_turnless_conversations_are_members_of_the_root(spark):
    lost = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 3)
    rows = [(lost, t, "user", "t") for t in range(2)]
    assert [r[:5] for r in trie(spark, rows, 10)] == [(lost, 0, None, 1, 0)]


def test_empty_table(spark):
    assert trie(spark, [], 10) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=5), max_size=60), st.sampled_from([1, 3, 256]))
def test_radix_tree_holds_its_keys_in_order(keys, letters):
    keys = sorted(bytes(b % letters for b in k) for k in keys)
    found, stack = [], [(radix_tree(keys), b"")]
    while stack:
        node, at = stack.pop()
        at += node.prefix
        assert len(node.children()) <= node.places in (4, 16, 48, 256)
        if node.ends:
            found += [at] * (node.ends[1] - node.ends[0])
        byte_of = {id(node.child(b)): b for b in range(256) if node.child(b) is not None}
        stack += [(kid, at + bytes([byte_of[id(kid)]])) for kid in reversed(node.children())]
    assert found == keys


def test_layouts_grow():
    node, places = Node(b"", 0), []
    for byte in range(255, -1, -1):
        node.put(byte, Node(bytes([byte]), 0))
        places.append(node.places)
    assert [places.count(n) for n in (4, 16, 48, 256)] == [4, 12, 32, 208]
    assert [k.prefix[0] for k in node.children()] == list(range(256))
    node.put(7, Node(b"new", 0))
    assert node.child(7).prefix == b"new" and len(node.children()) == 256
