"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


# SimHash


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, distance=2):
    """fps: {node: value}"""
    nodes = sorted(fps)
    parent = {n: n for n in nodes}
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {n: find(parent, n) for n in nodes}


def test_simhash_equals_brute_force(docs, crowded, corpus):
    from terraframe.llm.simhash import near_duplicates

    fps = {d: brute_fingerprint(t) for d, t, *_ in corpus if d is not None}
    want = brute_components(fps)
    got = near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    assert len(set(want.values())) < len(want) - 10
    assert sorted(map(str, near_duplicates(crowded).collect())) == sorted(map(str, got))


def test_simhash_links_random_fingerprints(spark):
    """Chains and clusters at every distance; links are found whatever bits differ."""
    import random

    from terraframe.llm.common import connected_components
    from terraframe.llm.simhash import link

    rnd, fps = random.Random(5), []
    for _ in range(40):
        v = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 5, 12])):
            fps.append(v)
            for _ in range(rnd.choice([1, 2, 2, 3])):
                v ^= 1 << rnd.randrange(64)
    fps = {i: f for i, f in enumerate(dict.fromkeys(fps))}
    want = brute_components(fps)
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in fps.items()}
    classes = spark.createDataFrame([(f,) for f in signed.values()], "fp long")
    for small in (32, 4, 1):  # crowded cells from 33, 5 or 3 on
        got = {r.node: r.component for r in connected_components(link(classes, small=small)).collect()}
        found = collections.defaultdict(list)
        for i, f in signed.items():
            found[got.get(f, f)].append(i)
        assert {i: min(x) for x in found.values() for i in x} == want


def test_simhash_empty(empty):
    from terraframe.llm.simhash import near_duplicates

    assert near_duplicates(empty).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 90)] + [(5, 200), (200, 300)], [(i, i * 7 % 50) for i in range(50)]])
def test_components(spark, edges):
    from terraframe.llm.common import connected_components

    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(parent, n) for e in edges if e[0] != e[1] for n in e}
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == want


# substring dedup


def brute_passages(rows, window=20):
    """[(id, words, removed, sha)] with ids in order; windows are judged by (id, start)."""
    last = 1 << 62
    starts = {}
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k, at = tuple(w[i : i + window]), (last if d is None else d, i)
            starts[k] = min(starts.get(k, at), at)
    out = []
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] < (last if d is None else d, i):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (3, 2), (5, 3)])
def test_passages_equal_brute_force(docs, corpus, batches, fan_out):
    from terraframe.llm.substring_dedup import deduplicate

    got = deduplicate(docs, batches=batches, fan_out=fan_out)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_passages(corpus)


def test_passages_keep_text_and_columns(docs, crowded, corpus):
    from terraframe.llm.substring_dedup import deduplicate

    got = deduplicate(crowded, texts=True, into="found")
    assert got.columns == [*crowded.columns, "found"]
    rows = got.collect()
    assert all(r[c] == -1 for r in rows for c in crowded.columns if c not in docs.columns)
    for r in rows:
        kept = (r.text or "").encode().split()
        assert len(kept) == r.found.n_words - r.found.n_removed and hashlib.sha256(b" ".join(kept)).hexdigest() == r.found.kept_sha256
    assert collections.Counter((r.doc_id, *r.found) for r in rows) == brute_passages(corpus)
    # without a name of its own a result takes the place of a column of the same name
    assert deduplicate(crowded, texts=True).columns == [*(c for c in crowded.columns if c != "n_words"), "n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("backwards", [False, True])
def test_index_is_opened_again(spark, docs, corpus, backwards):
    """Three batches in three sessions of the index: what an earlier one brought counts as earlier, whatever its ids."""
    from terraframe.llm import substring_dedup as sd
    from terraframe.llm.common import fresh

    folder = fresh(spark, "index")
    cuts = [(None, 30), (30, 60), (60, None)]
    got, merges = [], 0
    for k, (low, high) in enumerate(reversed(cuts) if backwards else cuts):
        index = sd.Index.open(spark, folder) if k else sd.Index(spark, folder)
        here = docs.filter("doc_id IS NOT NULL")
        here = here if low is None else here.filter(f"doc_id >= {low}")
        here = here if high is None else here.filter(f"doc_id < {high}")
        store, marks = index.ingest(here)
        got += sd.stripped(store, marks, sd.WINDOW, False).collect()
        assert index.merges >= merges
        merges = index.merges
        for run in [r for rs in index.runs.values() for r in rs] + index.texts:
            spark.sql(f"DROP TABLE {run['name']}")  # as a session without them; the files stay
    assert merges >= 3  # every kind of run was compacted
    rank = {None: 9} | {d: next(i for i, (low, high) in enumerate(reversed(cuts) if backwards else cuts) if (low is None or d >= low) and (high is None or d < high)) * 1000 + d for d, *_ in corpus if d is not None}
    back = {v: k for k, v in rank.items()}
    want = collections.Counter({(back[d], *x): n for (d, *x), n in brute_passages([(rank[d], *x) for d, *x in corpus if d is not None]).items()})
    assert collections.Counter(tuple(r) for r in got) == want


def test_passages_with_ids_of_text(spark):
    from terraframe.llm.substring_dedup import deduplicate

    passage = " ".join(f"w{i}" for i in range(25))
    rows = [("b", passage + " x"), ("a", "y " + passage), (None, passage), ("c", None)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in deduplicate(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": (26, 0), "b": (26, 25), None: (25, 25), "c": (0, 0)}


def test_passages_empty(empty):
    from terraframe.llm.substring_dedup import deduplicate

    assert deduplicate(empty).collect() == []


def test_small_windows_in_small_vocabularies(spark):
    import random

    from terraframe.llm.substring_dedup import deduplicate

    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices("ab", k=rnd.randrange(0, 40)))) for i in range(40)]
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), window=6, anchor=2, batches=3)
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_passages(rows, 6)


# WARC


def test_warc_round_trip(spark):
    from terraframe.llm import warc

    big = "<html>" + "x" * 200 + "</html>"
    rows = [(5, "http://a", big), (3, "http://b", big), (9, None, big), (9, "http://c", big), (4, "http://d\r\nX: y", "short"), (6, "http://e", "short"), (7, "http://f", None), (8, "http://g", "é\r\n\r\nWARC/1.1"), (10, "u", "z" * 99), (11, "u", "z" * 99), (12, "u", "w" * 2_000_000), (3, "http://b2", big), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("n", F.lit(2))
    folder = warc.fresh(spark, "w")
    index = warc.write(pages, folder)
    got = warc.read(index, folder).collect()
    assert len(got) == len(rows) and sum(r.refers_to == 3 for r in got) == 4
    for r in got:
        want = next((h or "").encode() for i, u, h in rows if i == r.id and (r.payload is None or (h or "").encode() == bytes(r.payload)))
        assert r.payload_digest == hashlib.sha256(want).hexdigest() and r.payload_bytes == len(want)
        assert r.record_type == ("revisit" if r.refers_to is not None else "response")
    some = warc.read(index.filter("url = 'http://f' OR id = 12"), folder).collect()
    assert sorted(r.id for r in some) == [7, 12]
    assert warc.archive(pages.limit(0)).collect() == []


def test_warc_records_are_read_by_offset(spark):
    """Bytes of the index alone give a record, as any reader of the format finds it."""
    import gzip

    from terraframe.llm import warc
    from terraframe.llm.common import mapped

    pages = spark.createDataFrame([(i, f"http://{i}", "p" * i) for i in range(50)], "page_id long, url string, html string")
    folder = warc.fresh(spark, "w")
    for r in warc.write(pages, folder).collect():
        data = gzip.decompress(bytes(mapped(f"{folder}/{r.file}")[r.offset : r.offset + r.length]))
        assert data.startswith(b"WARC/1.1\r\n") and f"WARC-Target-URI: http://{r.id}\r\n".encode() in data and data.endswith(b"p" * r.id + b"\r\n\r\n")


# quality rules


def brute_quality(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = collections.Counter(grams)
    repeat = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    bad = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), bad


def test_quality_equals_brute_force(docs, crowded, corpus):
    from terraframe.llm.quality_rules import judge

    got = judge(crowded, into="verdict")
    assert got.columns == [*crowded.columns, "verdict"]
    assert all(r[c] == -1 for r in got.collect() for c in crowded.columns if c not in docs.columns)
    assert judge(crowded).columns == [*(c for c in crowded.columns if c != "rules"), "rules"]
    assert judge(docs.limit(0)).collect() == []
    want = collections.Counter((d, *brute_quality(t)) for d, t, *_ in corpus)
    rows = judge(docs).select("doc_id", "rules.*").collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert judge(docs).filter("rules.kept").count() == sum(r.kept for r in rows)


def test_quality_divergence(spark):
    from terraframe.llm.quality_rules import judge

    import random

    rnd = random.Random(8)
    clean = " ".join(rnd.choices(["the", "of", "and", "to", "a", "in", "is", "that"], [62, 37, 26, 20, 16, 14, 12, 10])[0] if rnd.random() < 0.2 else "".join(rnd.choices("aeioulnrst", k=6)) for _ in range(150))
    clean = ". ".join(clean[i : i + 60].strip().capitalize() for i in range(0, len(clean), 60))
    rows = [(1, clean), (2, clean.upper().replace(" ", "!! ")), (3, " | ".join(f"cell{i}" for i in range(200))), (4, "short text"), (5, " ".join(f"zqx{i}w" for i in range(100)))]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "rules.*").collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and got[4].base_failed and not got[5].kept
    assert got[4].word_distance is None and got[4].class_distance is None and 0 <= got[1].word_distance < got[5].word_distance <= 1


# sharding


def test_sharding_is_even_and_gapless(docs, crowded, corpus, empty):
    from terraframe.llm.sharding import assign

    got = assign(docs).collect()
    assert len(got) == len(corpus)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(per) == list(range(16)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in corpus)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sorted(map(str, assign(crowded).collect())) == sorted(map(str, got))
    assert assign(empty).collect() == []


def test_sharding_equals_a_walk_round_the_ring(spark):
    from terraframe.llm import sharding

    n, shards, vnodes = 1000, 5, 8
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    keys = {r.doc_id: (r.h, r.k) for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", F.crc32(F.lit("x").cast("binary")), F.lit(2).cast("long")).alias("k")).collect()}
    nodes = sharding.ring(shards, vnodes)
    arc = lambda p: sum(q < p for q, _ in nodes) % len(nodes)
    place = lambda p: p - sharding.RING if p > nodes[-1][0] else p
    pos = {d: h % sharding.RING for d, (h, _) in keys.items()}
    order = sorted(keys, key=lambda d: (arc(pos[d]), place(pos[d]), keys[d][1] % sharding.SUBS, keys[d][1], d))
    room = [n // shards + (s < n % shards) for s in range(shards)]
    want = {}
    for d in order:
        s = next(s for s in sharding.preference(nodes, arc(pos[d])) if room[s])
        room[s] -= 1
        want[d] = s
    assert {r.doc_id: r.shard for r in sharding.assign(docs, shards=shards, vnodes=vnodes).collect()} == want


def test_few_keys_move_when_a_shard_is_added(spark):
    from terraframe.llm.sharding import assign

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b = ({r.doc_id: r.shard for r in assign(docs, shards=k).collect()} for k in (16, 17))
    assert sum(a[d] != b[d] for d in a) < 0.16 * len(a)  # 1 / 17 is the least


def test_one_id_may_hold_most_rows(spark):
    from terraframe.llm.sharding import assign

    same = spark.range(4000).select(F.lit(7).alias("doc_id"), F.when(F.col("id") % 2 == 0, "x").otherwise(F.col("id").cast("string")).alias("text"))
    got = assign(same.union(spark.range(500).selectExpr("CAST(NULL AS INT)", "'same'")).repartition(5)).collect()
    per = collections.Counter(r.shard for r in got)
    assert len(got) == 4500 and max(per.values()) - min(per.values()) <= 1
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


# mixing


def test_targets_share_all_and_stop_at_the_cap():
    from terraframe.llm.mixing import targets

    order, size = ["a", "b", "c", None], {"a": 10, "b": 1000, "c": 500, None: 0}
    weights = {"a": 1, "b": 2, "c": 3, None: 1}
    t = targets(order, size, weights, 1510)
    assert t["a"] == 30 and t[None] == 0 and abs(sum(t.values()) - 1510) < 1e-6 and abs(t["c"] / t["b"] - 1.5) < 1e-9


def test_flow_is_cheapest():
    """Against all splits of a small case: least sum of squares of passes."""
    import itertools

    from terraframe.llm.mixing import flow

    capacity, members, quota = {0: 3, 1: 3, 2: 3}, {0: [0], 1: [0, 1], 2: [1]}, {0: 6, 1: 6}
    got = flow(capacity, members, quota)
    price = lambda n, c: sum((i // c + 1) ** 2 for i in range(n))
    cost = sum(price(sum(v for (q, _), v in got.items() if q == p), capacity[p]) for p in capacity)
    best = min(price(a, 3) + price(6 - a + 6 - b, 3) + price(b, 3) for a, b in itertools.product(range(7), repeat=2))
    assert cost == best and all(sum(v for (_, t), v in got.items() if t == s) == q for s, q in quota.items())


def test_mixing(docs, crowded, corpus, empty):
    import re

    from terraframe.llm.mixing import mix

    got = mix(docs).collect()
    assert len(got) == len(corpus)
    sizes = collections.Counter()
    for _, t, _, s, _ in corpus:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken, target, biggest = collections.Counter(), {}, collections.Counter()
    for r in got:
        s = r.sources[0]
        assert r.source_size == sizes[s] and r.taken in {0, r["size"], 2 * r["size"], 3 * r["size"]}
        taken[s] += r.taken
        target[s] = r.target
        biggest[s] = max(biggest[s], r["size"])
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-3
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1 for s in target)
    assert sorted(map(str, mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    assert sorted(map(str, mix(crowded, keep=crowded.columns).drop("kept").collect())) == sorted(map(str, got))
    assert mix(empty).collect() == []


def test_flow_is_cheapest_in_random_cases():
    """The least cost by the cuts: what k passes can serve is the least, over sets of sources, of the others' quotas and k times what the set's patterns hold."""
    import itertools
    import random

    from terraframe.llm.mixing import flow

    rnd = random.Random(6)
    for _ in range(150):
        sources = list(range(rnd.randrange(1, 5)))
        members = {p: sorted(rnd.sample(sources, rnd.randrange(1, len(sources) + 1))) for p in range(rnd.randrange(1, 9))}
        capacity = {p: rnd.randrange(0, 12) for p in members}
        quota = {s: rnd.randrange(0, 25) for s in sources}
        got = flow(capacity, members, quota)
        assert all(s in members[p] for p, s in got) and all(sum(v for (_, t), v in got.items() if t == s) <= quota[s] for s in sources)
        sets = [set(c) for n in range(len(sources) + 1) for c in itertools.combinations(sources, n)]
        most = [min(sum(q for s, q in quota.items() if s not in t) + k * sum(capacity[p] for p in members if t & set(members[p])) for t in sets) for k in range(4)]
        used = {p: sum(v for (q, _), v in got.items() if q == p) for p in members}
        assert sum((i // capacity[p] + 1) ** 2 for p in members for i in range(used[p])) == sum((2 * k - 1 + (k - 1) ** 2) * (most[k] - most[k - 1]) for k in (1, 2, 3))
        assert sum(used.values()) == most[3]


def test_mixing_keeps_rows_without_sources(spark, monkeypatch):
    from terraframe.llm import mixing

    rows = [(i, "w " * 10, None if i % 9 == 0 else [] if i % 9 == 1 else [["a"], ["a", "b"], ["b", "c"], ["c", None], ["d", "a"], ["d"]][i % 6]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    for most in (200_000, 2):  # all patterns as they are, or two of them
        monkeypatch.setattr(mixing, "MAX_PATTERNS", most)
        got = mixing.mix(df, sources=F.col("sources")).collect()
        assert sorted(r.doc_id for r in got) == list(range(90))
        assert all(r.taken == 0 and r.target is None and r.source_size is None for r in got if r.doc_id % 9 < 2)
        assert all(set(r.passes) <= set(r.sources) and r.taken <= 30 for r in got)
        by, target = collections.Counter(s for r in got for s in r.passes), {r.sources[0]: r.target for r in got if r.sources}
        assert all(abs(10 * by[s] - t) <= 16 for s, t in target.items())  # half a document where a pattern is split


def test_mixing_overlapping_sources(spark):
    from terraframe.llm.mixing import mix

    rows = [(i, "w " * 10, ["a"] if i < 20 else ["a", "b"] if i < 60 else ["b", "c"] if i < 90 else []) for i in range(100)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, sources array<string>"), {"a": 1, "b": 1, "c": 1}, sources=F.col("sources")).collect()
    by = collections.Counter(s for r in got for s in r.passes)
    assert max(by.values()) - min(by.values()) <= 1 and sum(by.values()) == 90
    assert all(set(r.passes) <= set(r.sources) for r in got) and all(not r.passes for r in got if r.doc_id >= 90)


# embeddings


def test_embeddings_equal_brute_force(spark, monkeypatch):
    from terraframe.llm import embedding_dedup as ed

    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:10] + rng.normal(size=(10, 16)) * 0.2, base[:10] * 3, np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.12]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] + [1.0] * 15, 0), (203, [None] + [1.0] * 15, 0), (204, [1.0, 2.0], 0), (205, [1.0, 2.1], 0), (206, [], 0), (207, [float("inf")] + [1.0] * 15, 0)]
    y = x.astype(np.float64)
    near = (y @ y.T) / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1)) >= 0.95
    np.fill_diagonal(near, False)
    parent = {i: i for i in range(len(x))}
    for i, j in zip(*np.nonzero(near)):
        a, b = find(parent, int(i)), find(parent, int(j))
        parent[max(a, b)] = min(a, b)
    want = {i: (int(near[i].sum()), find(parent, i)) for i in range(len(x))} | {i: (0, i) for i, *_ in odd} | {204: (1, 204), 205: (1, 204)}
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("n", F.lit(1))
    for block, leaf, sample in ((1024, 512, 2048), (8, 4, 50), (4, 16, 20)):
        monkeypatch.setattr(ed, "BLOCK", block)
        monkeypatch.setattr(ed, "LEAF", leaf)
        monkeypatch.setattr(ed, "SAMPLE", sample)
        got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicates(df).collect()}
        assert got == want
    assert ed.near_duplicates(df.limit(0)).collect() == []
    assert all(r.n_links == 1 for r in ed.near_duplicates(df.filter("vec_id = 3").union(df.filter("vec_id = 3"))).collect())


def manifold(rng, n, dim=24):
    """Vectors that clump on a curved surface of two dimensions: clusters of clusters, at every scale."""
    at = rng.uniform(0, 1, (max(1, n // 200), 2))[rng.integers(0, max(1, n // 200), n)] + rng.normal(size=(n, 2)) * 0.004
    waves = np.concatenate([f(2 * np.pi * k * at) for k in (1, 2, 3) for f in (np.cos, np.sin)], axis=1)
    return np.concatenate([waves, np.ones((n, dim - waves.shape[1])) * 0.2], axis=1)


def brute_vectors(x, threshold):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    parent = {i: i for i in range(len(x))}
    for i, j in zip(*np.nonzero(np.triu(near))):
        a, b = find(parent, int(i)), find(parent, int(j))
        parent[max(a, b)] = min(a, b)
    return {i: (int(near[i].sum()), find(parent, i)) for i in range(len(x))}


def test_traversal_of_clustered_vectors(spark, monkeypatch):
    """Several rounds of subtrees, node pairs taken whole, and far fewer comparisons than all pairs."""
    from terraframe.llm import embedding_dedup as ed

    monkeypatch.setattr(ed, "LEAF", 32)
    monkeypatch.setattr(ed, "MAX_NODES", 24)
    monkeypatch.setattr(ed, "SAMPLE", 200)
    seen = {}
    real = ed.candidates

    def noted(rows, trees, *rest):
        out = real(rows, trees, *rest)
        sizes = {r["node"]: r["count"] for r in rows.groupBy("node").count().collect()}
        seen["work"] = sum(sizes[r.a] * sizes[r.b] for r in out[0].collect())
        seen["rounds"], seen["whole"] = trees.agg(F.max("round")).first()[0], out[1].count()
        return out

    monkeypatch.setattr(ed, "candidates", noted)
    work = {}
    for n in (1000, 3000, 9000):
        x = manifold(np.random.default_rng(n), n)
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
        got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicates(df, threshold=0.999).collect()}
        assert got == brute_vectors(x, 0.999)
        work[n] = seen["work"]
        assert seen["rounds"] >= 1 and seen["whole"] > 0
    assert work[9000] < work[1000] * 9**1.3 and work[9000] < 9000**2 / 8


def test_cosine_is_taken_in_double_precision(spark):
    """Pairs nearer to the threshold than single precision can tell."""
    from terraframe.llm.embedding_dedup import near_duplicates

    angle = np.arccos(0.95)
    rows = [(1, [1.0, 0.0]), (2, [float(np.cos(angle - 2e-9)), float(np.sin(angle - 2e-9))]), (3, [0.0, 0.0, 1.0]), (4, [0.0, float(np.sin(angle + 2e-9)), float(np.cos(angle + 2e-9))])]
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_any_number_of_lengths(spark):
    from terraframe.llm.embedding_dedup import near_duplicates

    rows = [(10 * n + k, [1.0] * n if k < 2 else [1.0] * (n - 1) + [-1.0]) for n in range(2, 40) for k in range(3)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, k = divmod(r.vec_id, 10)
        assert (r.n_links > 0, r.component_id) == ((True, 10 * n) if k < 2 or (n - 2) / n >= 0.95 else (False, r.vec_id))


def test_cover_tree_nests_and_halves():
    from terraframe.llm.embedding_dedup import Subtree, cover_tree

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + rng.normal(size=(60, 8)) * 0.05 for c in centres])
    x /= np.linalg.norm(x, axis=1)[:, None]
    nodes = cover_tree(x, 2.0, 0.05)
    assert len(nodes) > 12 and all(p < k for k, (p, *_) in enumerate(nodes))
    tree = Subtree([p for p, *_ in nodes], x[[c for _, c, _ in nodes]], [r for *_, r in nodes])
    for k, kids in enumerate(tree.children):
        if kids:
            assert nodes[kids[0]][1] == nodes[k][1]  # a node's own centre is among its children's
            apart = np.linalg.norm(tree.centres[kids][:, None] - tree.centres[kids][None], axis=2)[~np.eye(len(kids), dtype=bool)]
            assert apart.min() > nodes[kids[0]][2] and nodes[kids[0]][2] <= nodes[k][2] / 2
    leaf, passed = Subtree.unpack(tree.pack()).descend(x)
    for rows, k, dist in passed:
        assert np.allclose(dist, np.linalg.norm(x[rows] - tree.centres[k], axis=1))
    for k in np.unique(leaf):
        assert np.ptp(x[leaf == k], axis=0).max() < 0.7 and not tree.children[k]


# classifiers


def labelled(spark, make, n=400):
    import random

    rnd = random.Random(4)
    rows = [(i, make(rnd, i % 4 != 0), i % 4 != 0) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(n, ""), (n + 1, None), (None, "the text of")], "doc_id long, text string").withColumn("y", F.lit(9)).withColumn("score", F.lit(9))
    return docs, rows


def test_compression_classifier(spark):
    from terraframe.llm.compression_classifier import classify

    docs, rows = labelled(spark, lambda rnd, good: " ".join(rnd.choice(["the", "house", "garden", "of", "river", "light"]) if good else rnd.choice(["BUY!!", "NOW!!", "$$$", "CLICK!!"]) + str(rnd.randrange(9)) for _ in range(80)))
    labels = spark.createDataFrame([(i, int(y), 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.97
    assert classify(docs.limit(0), labels).collect() == []
    assert {r.predicted for r in classify(docs, labels.limit(0)).collect()} == {1}


def test_toxicity(spark):
    from terraframe.llm.toxicity import classify

    plain = "the house of green light and river stone walks over a hill with many trees".split()
    docs, rows = labelled(spark, lambda rnd, toxic: " ".join(rnd.choices(plain, k=40) + (rnd.sample(["idiot", "grumfen", "grumpo", "moron"], 2) if toxic else [])))
    labels = spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.97
    assert got[len(rows)].predicted == got[len(rows) + 1].predicted == 0
    assert classify(docs.limit(0), labels).collect() == []


def test_scores_equal_a_plain_count(spark):
    """Toxicity: every term sought word by word, in whole texts."""
    import math
    import re

    from terraframe.llm import toxicity

    terms = ["idiot", "grum*", "scum", "gru*"]
    groups = [[0], [2]]
    n = len(terms) + len(toxicity.PATTERNS) + len(groups) + 2
    model = {"terms": terms, "groups": groups, "coefficients": [0.3 * (i + 1) * (-1) ** i for i in range(n)], "intercept": -0.7}
    texts = ["", None, "An IDIOT, idiot idiots.", "grum grumpy grumble Grüm !!!! gru", "you are an idiot!!! shut up", "scum" * 3 + " scum_scum scum1 1scum " + "x " * 9000 + "scum", "agrumb grumgrumgrum"]
    got = {r.id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        low = (t or "").lower()
        found = re.findall(r"[^\W\d_]+", low)
        counts = [sum(w.startswith(x[:-1]) and len(w) > len(x) - 1 if x.endswith("*") else w == x for w in found) for x in terms]
        hits = [len(re.findall(p, low)) for p in toxicity.PATTERNS.values()]
        x = [math.log1p(v) for v in (*counts, *hits, *(sum(counts[k] for k in g) for g in groups), sum(c > 0 for c in counts))] + [float(any(counts))]
        z = model["intercept"] + sum(a * b for a, b in zip(model["coefficients"], x))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-12


def test_compression_scores_equal_plain_sizes(spark):
    """Compression: the sizes of a text's pieces under either dictionary, one call each."""
    import math

    import zstandard
    from terraframe.llm import compression_classifier as cc

    good, bad = cc.build([("the light of the house and the river " * 40).encode()] * 20), cc.build([("BUY NOW !!! $$$ click " * 60).encode()] * 20)
    model = {"good": good, "bad": bad, "slopes": [0.4, -1.1], "intercept": 0.2}
    texts = ["", None, "the light of the river", "BUY NOW " * 2000, "é日本 " * 1500, "the house " * 20_000]
    got = {r.id: r.score for r in cc.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        sizes = []
        for d in (good, bad):
            params = zstandard.ZstdCompressionParameters.from_level(cc.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
            sizes.append(sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=params).compress(data[k : k + cc.PIECE])) for k in range(0, len(data), cc.PIECE)))
        x = (100 * (sizes[1] - sizes[0]) / sum(sizes), max(0.0, math.log(len(data) / min(sizes) / cc.USUAL))) if data else (0.0, 0.0)
        z = model["intercept"] + sum(a * b for a, b in zip(model["slopes"], x))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_long_labelled_texts_are_sampled_in_part(spark):
    from terraframe.llm.training import labelled_sample

    docs = spark.createDataFrame([(i, "ab" * 50 * (i + 1)) for i in range(20)] + [(20, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(21)] + [(3, 1)], "doc_id long, quality int")
    sample, counts = labelled_sample(docs, labels, "quality", 10**9, 5, chars=300)
    assert len(sample) == 21 and counts == {0: 11, 1: 10} and max(len(t) for t, _ in sample) == 300 and ("", 0) in sample


def test_label_model_finds_accuracies_and_copies():
    from terraframe.llm.toxicity import label_model

    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    flip = lambda p: np.where(rng.random(4000) < p, y, ~y)
    good, fair, poor = flip(0.95), flip(0.85), flip(0.55)
    votes = np.stack([np.where(v, 1, -1) for v in (good, fair, flip(0.8), poor, poor, poor)], axis=1).astype(np.int8)
    q, rates, weight = label_model(votes, np.clip((votes > 0).mean(axis=1), 0.05, 0.95))
    assert ((q > 0.5) == y).mean() > 0.93 and weight[3] < 0.5 < weight[0] and rates[0, 1, 2] > 0.85


# SentencePiece


def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")


TEXTS = ["hello world", " hello", "hello  world\n\tx ", "", "é ﬁ Ａ é", "<s> </s> <unk>", "▁a b", "日本語 😀\x00x", "a\n\nb \n c", "  \n ", "y" * 500, "      six", "x\r\ny", "aaaaaaaaab" * 30, "▁▁▁ ▁", "tab\ttab", "!!!???...", "=" * 70]


def test_encoding_equals_the_library(spark, docs, corpus, monkeypatch):
    from terraframe.llm import sentencepiece_lattice as sl

    model, sp = sl.load_model(spark), processor()
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    texts = collections.Counter([t for _, t, *_ in corpus] + TEXTS)
    for size in (1 << 16, 40):  # a few parts of the dictionary, or many
        monkeypatch.setattr(sl, "PART_WORDS", size)
        coded = sl.encode(both.withColumn("word", F.lit(1)).withColumn("tokens", F.lit(2)), model, decode_to="decoded")
        assert coded.columns == ["doc_id", "text", "word", "tokens", "decoded"]
        rows = coded.collect()
        assert collections.Counter(r.text for r in rows) == texts
        for r in rows:
            if r.text is None:
                assert r.tokens is None and r.decoded is None
            else:
                assert np.frombuffer(bytes(r.tokens), "<i4").tolist() == sp.encode(r.text)
                assert r.decoded == sp.decode(sp.encode(r.text))
    assert sorted(map(str, sl.decode(coded, model).collect())) == sorted(map(str, rows))
    assert sl.encode(both.limit(0), model).collect() == []


def test_long_words_cost_in_proportion(spark):
    """Texts without spaces are one word each."""
    import random
    import time

    from terraframe.llm import sentencepiece_lattice as sl

    model, sp, rnd = sl.load_model(spark), processor(), random.Random(1)
    took = {}
    for n in (1000, 20_000, 80_000):
        text = "".join(rnd.choices("thequickabno日本語é", k=n))
        began = time.perf_counter()
        (row,) = sl.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, decode_to="decoded").collect()
        took[n] = time.perf_counter() - began
        assert np.frombuffer(bytes(row.tokens), "<i4").tolist() == sp.encode(text) and row.decoded == text
    assert took[80_000] < 6 * took[20_000]


def test_dictionary_is_read_in_parts():
    """Without a mounted folder a task holds HELD_PARTS parts at most."""
    import struct

    import pyarrow as pa
    from terraframe.llm import sentencepiece_lattice as sl
    from xxhash import xxh3_64_intdigest

    bits, words = 6, [f"w{i}" for i in range(3000)]
    files = {}
    for k in range(1 << bits):
        mine = sorted((xxh3_64_intdigest(w), w) for w in words if xxh3_64_intdigest(w) >> (64 - bits) == k)
        ids = [w.encode() for _, w in mine]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        files[f"f/part-{k}"] = struct.pack("<Q", len(mine)) + np.array([h for h, _ in mine], "<u8").tobytes() + ends.astype("<u4").tobytes() + b"".join(ids)
    table = sl.Dictionary("f", bits)
    table.mapped = files.get
    asked = pa.array([words[i * 7 % 3000] for i in range(3000)] + [""])
    assert table.look_up(asked).to_pylist() == [w.encode() for w in asked.to_pylist()] and len(table.parts) == sl.HELD_PARTS
    assert table.look_up(pa.array(["w5", "", "w7"])).to_pylist() == [b"w5", b"", b"w7"]
    with pytest.raises(RuntimeError):
        table.look_up(pa.array(["missing"]))


def test_both_styles_of_folding_agree(spark):
    from terraframe.llm.sentencepiece_lattice import Splitter, lattice, load_model

    model = load_model(spark)
    words = sorted({w for t in TEXTS for w in Splitter(model)(t) if len(w) < 80} | {"▁representation", "▁thatonthe", "ghtbleing"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    a = {r.word: r.ids for r in lattice(df, model).collect()}
    assert a == {r.word: r.ids for r in lattice(df, model, style="sql").collect()} and set(a) == set(words)


def test_viterbi_equals_all_segmentations(spark):
    import itertools

    from terraframe.llm.sentencepiece_lattice import Model, lattice

    pieces = (("a", 1, -2.0), ("b", 2, -2.5), ("ab", 3, -3.0), ("ba", 4, -3.1), ("aba", 5, -4.0), ("bb", 6, -6.0))
    model = Model(pieces, ("<unk>", *(p for p, _, _ in pieces)), (2, *[1] * 6), False, False, (), 0)
    score = {p: (i, s) for p, i, s in pieces}
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)] + ["acb", "c"]

    def best(w):
        options = []
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(w)]
            parts = [w[a:b] for a, b in zip([0, *ends], ends)]
            if all(p in score or len(p) == 1 for p in parts):
                options.append((sum(score[p][1] if p in score else -16.0 for p in parts), [score[p][0] if p in score else 0 for p in parts]))
        return max(options, key=lambda o: o[0])

    df = spark.createDataFrame([(w,) for w in words], "word string")
    value = {i: s for _, i, s in pieces} | {0: -16.0}
    for style in ("arrow", "sql"):
        got = {r.word: r.ids for r in lattice(df, model, style=style).collect()}
        assert all(abs(sum(value[i] for i in got[w]) - best(w)[0]) < 1e-9 for w in words)
        assert got["acb"] == [1, 0, 2] and got["c"] == [0]


# skew-safe join


def test_attach_equals_a_left_join(spark, monkeypatch):
    from terraframe.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = spark.createDataFrame([(i, "h" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 10}") for i in range(100)], "i long, k string")
    groups = rows.filter("k IS NOT NULL AND k <> 'k4'").groupBy("k").agg(F.min("i").alias("low"), F.count("*").alias("n"))
    got = common.attach(rows, groups, "k", "n", ["low"], F.col("i"))
    want = rows.join(groups.select("k", "low"), "k", "left").select("i", "k", "low")
    assert got.columns == ["i", "k", "low"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # rows of a hot key are dealt out by their salt too
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = common.attach(rows, groups, "k", "n", ["low"], F.col("i"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(k#\d+, _s#\d+", plan)


# oracles and the pipeline


@pytest.mark.parametrize("name", ["op1_warc", "op3_quality_rules", "op7_mixing"])
def test_queries_equal_their_sql(spark, name):
    from terraframe.llm.oracles import ORACLES
    from terraframe.llm.queries import QUERIES

    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    order = lambda cols, rows: sorted(str([r[cols.index(c)] for c in sorted(cols)]) for r in rows)
    assert order(df.columns, [tuple(r) for r in df.collect()]) == order(names, found.fetchall())


def test_pipeline_equals_stages_by_brute_force(spark, docs, tmp_path, corpus):
    import corpus_pipeline as p

    from terraframe.llm.mixing import mix
    from terraframe.llm.quality_rules import judge

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in p.STAGES:
        after = stage(spark, at, str(tmp_path))
        after.write.parquet(str(tmp_path / name))
        out[name] = at = spark.read.parquet(str(tmp_path / name))
        if name != p.STAGES[-1][0]:
            assert at.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out["quality_rules"].collect()]
    assert collections.Counter(kept) == collections.Counter((r.doc_id, r.text) for r in judge(docs).filter("rules.kept").collect())
    comps = brute_components({d: brute_fingerprint(t) for d, t in kept if d is not None})
    assert sorted(r.doc_id for r in out["simhash"].collect() if r.doc_id is not None) == sorted(d for d in comps if comps[d] == d)
    want = {(d, sha) for d, n, gone, sha in brute_passages([(r.doc_id, r.text) for r in out["simhash"].collect()]) if gone < n or not n}
    assert {(r.doc_id, hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest()) for r in out["substring_dedup"].collect()} == want
    times = {r.doc_id: len(r.passes) for r in mix(out["substring_dedup"]).collect()}
    assert collections.Counter(r.doc_id for r in out["mixing"].collect()) == collections.Counter({d: n for d, n in times.items() if n})
    sp, texts = processor(), {r.doc_id: r.text for r in out["mixing"].collect()}
    rows = out["sentencepiece"].collect()
    assert len(rows) == out["mixing"].count() and all(r.round_trip and np.frombuffer(bytes(r.tokens), "<i4").tolist() == sp.encode(texts[r.doc_id]) for r in rows)
    assert p.run(spark, str(tmp_path)).count() == len(rows)


def test_pipeline_keeps_columns_of_any_name(spark, docs, crowded, tmp_path):
    """Extra columns named like internal ones come through every stage unchanged, and change nothing."""
    import corpus_pipeline as p

    for k, df in enumerate((docs, crowded.withColumns({c: F.lit(-1) for c in ("rules", "found", "passes", "kept", "passes_", "row", "cap", "parts", "n_removed", "kept_sha256", "size", "_w")}))):
        df.write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        extra = [c for c in df.columns if c not in docs.columns]
        for name, stage in p.STAGES[:-1]:
            after = stage(spark, spark.read.parquet(str(tmp_path / str(k) / "documents.parquet") if name == "quality_rules" else at), "")  # noqa: F821
            at = str(tmp_path / str(k) / name)
            after.write.parquet(at)
            rows = spark.read.parquet(at)
            assert rows.columns == df.columns
            assert all(r[c] == -1 for r in rows.collect() for c in extra)
            if k:
                assert sorted(map(str, rows.select(docs.columns).collect())) == sorted(map(str, spark.read.parquet(str(tmp_path / "0" / name)).collect()))
        assert p.encoded(spark, spark.read.parquet(at), "").count() == rows.count()


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline as p

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).collect() == []


def test_different_texts_of_one_id_stay(spark):
    import corpus_pipeline as p

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "en", "r", 1), (2, a, "en", "s", 1)]
    for order in (rows, rows[::-1]):
        got = p.near_duplicates(spark, spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long"), "")
        assert sorted(map(tuple, got.collect())) == [(1, a, "en", "r", 1), (1, b, "en", "s", 1)]
