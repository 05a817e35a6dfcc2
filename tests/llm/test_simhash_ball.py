from __future__ import annotations

import random
import re

import pytest
import xxhash

from skysieve.llm.components import connected_components
from skysieve.llm.simhash_ball import ball_links, fingerprint, simhash_components


def brute_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", "  \t", "One", "Ärger ÄRGER a B c", "x y z", "a b c d e f g a b c", "x y z\x1fq w"])
def test_fingerprint_matches_brute_force(text):
    for size in (1, 3, 5):
        assert fingerprint(text.encode(), size) == brute_fingerprint(text, size)


def test_long_text_counts_all_shingles():
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(70_000))
    assert fingerprint(text.encode(), 3) == brute_fingerprint(text, 3)


def test_components_match_brute_force(spark, docs_of):
    rng = random.Random(1)
    base = [[rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randint(0, 30)) for _ in range(60)] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (4, "one"), (77, "z z z")]
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"w{rng.randint(0, 999)}"
        rows.append((100 + i, " ".join(words)))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(docs_of(rows), 3).collect())
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    names = brute_components([d for d, _ in rows], fps, 2)
    assert got == sorted((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, names))
    assert len(set(names)) < len(rows) - 30


def test_chain_of_links_is_one_component(spark):
    # each step turns two bits on: neighbours link, the ends are far apart
    fps = [(1 << (2 * i)) - 1 for i in range(32)]
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = ball_links(frame)
    roots = connected_components(frame.withColumnRenamed("fp", "node"), links).collect()
    assert len(roots) == 32 and len({r.root for r in roots}) == 1
    assert links.count() == 31


def test_hub_and_lonely_nodes(spark):
    nodes = spark.range(500).withColumnRenamed("id", "node")
    links = spark.range(1, 300).selectExpr("0L as a", "id as b").unionAll(spark.sql("select 400L, 401L"))
    found = {r.node: r.root for r in connected_components(nodes, links).collect()}
    assert len({found[i] for i in range(300)}) == 1 and found[400] == found[401] != found[0]
    assert len(set(found.values())) == 1 + 1 + 198


def test_empty_table_and_extra_columns(spark, docs_of):
    assert simhash_components(docs_of([])).collect() == []
    extra = docs_of([(1, "a b c")]).selectExpr("*", "1 as fp", "2 as root", "3 as fingerprint")
    assert [r.component_id for r in simhash_components(extra).collect()] == [1]


def test_null_id_takes_the_name_of_others(spark, docs_of):
    got = simhash_components(docs_of([(None, "a b c"), (9, "a b c")])).collect()
    assert {r.component_id for r in got} == {9}
