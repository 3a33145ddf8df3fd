import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.llm import components, exact_dedup, groups, jaccard, perplexity, substrings, urls

DOCS = "doc_id long, text string, node string, g string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for _ in range(60):
        rows.append(" ".join(word() for _ in range(rng.randint(0, 120))))
    for k in range(40):  # near copies
        w = rows[k % 8].split() or ["x"]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    for _ in range(40):  # a common passage among little else
        own = [word() for _ in range(rng.randint(1, 40))]
        at = rng.randint(0, len(own))
        rows.append(" ".join(own[:at]) + "\n" + passage + "  " + " ".join(own[at:]))
    rows += ["A b C d", "a B c D", "", None, " \t", rows[0], rows[0].upper(), "long " * 5000]
    return list(enumerate(rows)) + [(3, rows[3])]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_groups_are_brute_force(spark, monkeypatch):
    rows = texts()
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    out = jaccard.similar_groups(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    size = dict(sets)
    for r in out:
        assert r["n_shingles"] == len(size[r["doc_id"]]) and r["component_id"] == root(r["doc_id"])
    assert jaccard.similar_groups(frame(spark, [])).count() == 0


def test_jaccard_with_null_and_reused_ids(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(999)}" for _ in range(80)] for _ in range(4)]
    a, b, c, d = (" ".join(w) for w in base)
    near = lambda w: " ".join([*w[:-1], "end"])
    # Null ids with a link to 7 and to one another; id 1 has three unlike texts, two of which have near copies.
    rows = [(None, a), (7, near(base[0])), (None, b), (None, near(base[1])), (1, c), (1, d), (1, "alone"), (2, near(base[2])), (3, near(base[3]))]
    out = {}
    for r in jaccard.similar_groups(frame(spark, rows)).collect():
        out.setdefault(r["doc_id"], []).append(r["component_id"])
    assert out == {None: [None] * 3, 7: [None], 1: [1] * 3, 2: [1], 3: [1]}


def test_exact_dedup_with_colliding_digests(spark):
    rows = texts(2)
    squash = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[squash(t)].append((-len(t or ""), i))
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    for digest, files in ((exact_dedup.sha256_digest, 1), (weak, None)):
        out = exact_dedup.exact_dedup(frame(spark, rows).repartition(4), digest, files).collect()
        assert len(out) == len(rows)
        keep = {i: min(groups[squash(t)])[1] for i, t in rows}
        for r in out:
            assert r["keep_id"] == keep[r["doc_id"]] and r["kept"] == (r["keep_id"] == r["doc_id"])
            assert r["group_size"] == len(groups[squash(dict(rows)[r["doc_id"]])])
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_of_ids_with_two_texts(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "c"), (3, "c"), (4, "d"), (4, "d")]
    want = [(1, 1, 2), (1, 1, 1), (2, 1, 2), (None, None, 2), (3, None, 2), (4, 4, 2), (4, 4, 2)]
    one = lambda text: F.lit("x")
    for digest in (exact_dedup.sha256_digest, one):
        out = exact_dedup.exact_dedup(frame(spark, rows), digest).collect()
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["keep_id"], r["group_size"])) for r in out)


def test_exact_dedup_state_outlives_a_call(spark, tmp_path):
    one = lambda text: F.lit("x")
    for k, digest in enumerate((exact_dedup.sha256_digest, one)):
        calls = []
        for n, rows in enumerate(([(1, "a b"), (2, "c"), (3, "d")], [(4, "ab"), (5, "c  c"), (0, "d"), (6, " d ")])):
            path = str(tmp_path / f"docs{k}{n}")
            frame(spark, rows).write.parquet(path)
            out = exact_dedup.exact_dedup(spark.read.parquet(path), digest, state=str(tmp_path / f"state{k}"))
            calls.append(sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in out.collect()))
        assert calls == [[(1, 1, 1), (2, 2, 1), (3, 3, 1)], [(0, 6, 3), (4, 1, 2), (5, 5, 1), (6, 6, 3)]]


def test_exact_dedup_called_again_counts_once(spark, tmp_path):
    """A named batch that is run again, after it ended and after it died with its keys written, and one that died before."""
    state, calls = str(tmp_path / "state"), []
    for n, rows in enumerate(([(1, "a b"), (2, "c"), (3, "c ")], [(4, "ab"), (5, "e")])):
        path = str(tmp_path / f"docs{n}")
        frame(spark, rows).write.parquet(path)
        if n:  # keys without their mark, as a job leaves them that died while it was committing
            frame(spark, rows).write.parquet(f"{state}/keys/batch-{n}")
            (tmp_path / "state" / "keys" / f"batch-{n}" / "_SUCCESS").unlink()
        for _ in range(2):
            out = exact_dedup.exact_dedup(spark.read.parquet(path), state=state, batch=str(n))
            calls.append(sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in out.collect()))
    assert calls == [[(1, 1, 1), (2, 3, 2), (3, 3, 2)]] * 2 + [[(4, 1, 2), (5, 5, 1)]] * 2


def test_exact_dedup_with_many_hits(spark, monkeypatch):
    """More hits than are sent to every task: the same rows by the salted join."""
    rows = [(i, f"text {i % 7}  {'x' * (i % 3)}") for i in range(60)]
    want = sorted(map(str, exact_dedup.exact_dedup(frame(spark, rows)).collect()))
    monkeypatch.setattr(exact_dedup, "SENT_HITS", 3)
    one = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    assert sorted(map(str, exact_dedup.exact_dedup(frame(spark, rows)).collect())) == want
    key = lambda out: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out.collect())
    assert key(exact_dedup.exact_dedup(frame(spark, rows), one)) == key(exact_dedup.exact_dedup(frame(spark, rows)))


# Two words of 1,024 letters that every polynomial modulo 2**64 maps to the same number.
MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
ESROM = MORSE.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_cannot_tell_apart(spark):
    rng = random.Random(9)
    tail = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows = [(i, " ".join([*tail[:34], word])) for i, word in enumerate((MORSE, ESROM))]
    assert all(r["n_removed"] == 0 for r in substrings.drop_repeats(frame(spark, rows)).collect())
    rows = [(i, " ".join([word, tail[i], word, tail[i + 1], word])) for i, word in enumerate((MORSE, ESROM))] + [(2, MORSE), (3, ESROM), (4, MORSE.upper())]
    out = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(frame(spark, rows)).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    rows = list(zip(ids, (MORSE, MORSE, ESROM)))
    out = {r["doc_id"]: r for r in perplexity.score_texts(frame(spark, rows)).collect()}
    assert out[ids[0]]["base_score"] > out[ids[2]]["base_score"]


def test_names_of_sets_that_clash(spark, monkeypatch):
    named = jaccard._node
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(4)] + [(9, "a b a b a b a b"), (10, "b a b a b a b a b")]
    monkeypatch.setattr(jaccard, "_node", lambda s: named(s) if len(s) else None)
    first = {r["doc_id"]: r["set_id"] for r in jaccard.similar_groups(frame(spark, rows)).collect()}
    again = {r["doc_id"]: r for r in jaccard.similar_groups(frame(spark, rows), salt=5).collect()}
    assert all(again[i]["set_id"] != first[i] and again[i]["component_id"] == (9 if i > 8 else i) for i, _ in rows)
    # Two texts under one name: found by their words. The last two are one set in another order of words: no clash.
    for texts_, clash in ((rows[:2], True), (rows[4:], False), ([rows[0], (5, rows[0][1])], False)):
        measured = spark.createDataFrame([(1, bytes([i]), t.encode()) for i, (_, t) in enumerate(texts_)], "node long, digest binary, z binary")
        firsts = measured.groupBy("node").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
        assert jaccard._names_clash(measured, firsts, 5) == clash


def test_exact_shingles_are_sets_of_words():
    exact, rng = jaccard.Exact(5), random.Random(2)
    for _ in range(200):
        a, b = (" ".join(rng.choice("xYz") for _ in range(rng.randint(1, 30))) for _ in range(2))
        x, y = exact(a.encode()), exact(b.encode())
        assert (len(x), len(y), jaccard.in_both(x, y)) == (len(shingles(a)), len(shingles(b)), len(shingles(a) & shingles(b)))


def test_repeats_are_brute_force(spark):
    rows = texts(3)
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = collections.Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    out = substrings.drop_repeats(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == sorted(want)
    assert all(sum(n for _, n in r["removed"]) == r["n_removed"] for r in out)
    assert substrings.drop_repeats(frame(spark, [])).count() == 0


def test_scores(spark):
    rows = texts(4) * 3
    toks = lambda t: (t or "").lower().encode().split() + [b"\n"]
    train = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in toks(t))
    n, v = sum(train.values()), len(train)
    out = perplexity.score_texts(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    base = {i: sum(math.log10((train[w] + 1) / (n + v + 1)) for w in toks(t)) for i, t in rows}
    for r in out:
        assert abs(r["base_score"] - base[r["doc_id"]]) < 1e-6 * max(1, abs(r["base_score"])) and r["train_tokens"] == n and r["score"] < 0
        assert r["n_known"] <= r["n_tokens"]
    # One text is a single unknown word 5,000 times over, of which neither model can know anything.
    held = [r for r in out if r["held_out"] and r["n_tokens"] < 5000]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = perplexity.score_texts(frame(spark, rows).repartition(7)).collect()
    assert sorted((r["doc_id"], round(r["score"], 4)) for r in again) == sorted((r["doc_id"], round(r["score"], 4)) for r in out)
    assert perplexity.score_texts(frame(spark, [])).count() == 0


def test_scores_know_the_word_before(spark):
    rng = random.Random(6)
    starts = [rng.randrange(600) for _ in range(300)]
    rows = [(i, " ".join(f"w{(a + k) % 600}" for k in range(40))) for i, a in enumerate(starts)]
    held = [r for r in perplexity.score_texts(frame(spark, rows)).collect() if r["held_out"]]
    assert held and max(r["perplexity"] for r in held) < 2  # each of the 600 words has one successor


def test_scores_hang_on_no_partition_block_or_shard(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(x for _ in range(60) for x in (f"r{rng.randrange(400)}", "hot"))) for i in range(120)] + [(None, "hot r1"), (None, None), (5, "new words")]
    found = {}
    for parts, block, part, shard in ((3, 1 << 20, 1 << 21, 1 << 22), (7, 1 << 20, 3000, 1 << 22), (1, 500, 5000, 1 << 22), (3, 2000, 2000, 100)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            out = perplexity.score_texts(frame(spark, rows), block=block, part=part, shard=shard).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 3)
        found[parts, block] = sorted((str(r["doc_id"]), r["n_tokens"], r["base_score"], r["score"]) for r in out)
    first, *rest = found.values()
    assert len(first) == len(rows)
    for other in rest:
        assert [x[:2] for x in other] == [x[:2] for x in first]
        assert max(abs(x[k] - y[k]) for x, y in zip(first, other) for k in (2, 3)) < 1e-8


def test_predictions_sum_to_one(spark):
    """Over the vocabulary and one unknown word, behind a known word: one-word texts behind the start."""
    rng = random.Random(3)
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, rng.choice(["a", "b", "c d", ""])) for i in train]
    asked = ["a", "b", "c", "d", "", "x"]
    out = {r["doc_id"]: r["score"] for r in perplexity.score_texts(frame(spark, rows + [(i, t) for i, t in zip(held, asked)])).collect()}
    end = {t: out[i] for i, t in zip(held, asked)}
    # P(end | start) of the empty text, and P(w | start) P(end | w) of the others: each is at most P(w | start).
    assert 0.5 < sum(10 ** end[t] for t in asked) <= 1 + 1e-9


def seatings(c):
    """All arrangements of c customers at tables, as lists of sizes, by the customers' arrival."""
    found = [[]]
    for _ in range(c):
        found = [s[:k] + [s[k] + 1] + s[k + 1 :] for s in found for k in range(len(s))] + [[*s, 1] for s in found]
    return found


def test_tables_are_drawn_from_their_conditional():
    d, b, tables_else, base, c = 0.6, 1.0, 4, 0.2, 6
    weight = collections.Counter()
    for s in seatings(c):  # brute force over every seating of the dish
        w = math.prod((b + d * (tables_else + k)) * base for k in range(len(s)))
        weight[len(s)] += w * math.prod(math.prod(j - d for j in range(1, n)) for n in s)
    total, n = sum(weight.values()), 40_000
    draw = lambda f, c: f(np.arange(n, dtype=np.uint64), np.full(n, c), np.full(n, tables_else), np.full(n, base), d, b)
    got = np.bincount(draw(perplexity.draw_tables, c), minlength=c + 1)
    for t in range(1, c + 1):
        assert abs(got[t] / n - weight[t] / total) < 0.012


@pytest.mark.parametrize("d", [0.05, 0.5, 0.8, 0.95])
def test_large_counts_have_the_same_conditional(d):
    """Beyond the table that is kept, against sums of Stirling numbers, from few tables to nearly a table each."""
    c = 2300
    s, t = perplexity.stirling(d, c)[c, 1:], np.arange(1, c + 1)
    for a in (1 / d, 30.0, 1000.0, 1e6):
        for base in (1e-7, 1e-3, 0.05, 0.5):
            exact = s + np.cumsum(np.log(d * (a + t - 1))) + t * np.log(base)
            exact = np.exp(exact - exact.max())
            at, w = perplexity.conditional(c, a, base, d)
            got = np.zeros(c)
            got[at - 1] = w
            assert abs(exact / exact.sum() - got / got.sum()).sum() / 2 < 1e-5
    n = 4000
    got = perplexity.draw_tables(np.arange(n, dtype=np.uint64), np.full(n, c), np.full(n, 300), np.full(n, 0.01), d, 1.0)
    at, w = perplexity.conditional(c, 1 / d + 300, 0.01, d)
    mean = (at * w).sum() / w.sum()
    assert abs(got.mean() - mean) < 4 * math.sqrt(((at - mean) ** 2 * w).sum() / w.sum() / n) + 1e-9


def plain_scores(rows):
    """The model over dictionaries, a dish at a time, with the same draws; no parts, blocks or letters."""
    train, texts = set(), []
    for i, text in rows:
        hashes = [int(x) for x in perplexity.word_hashes((text or "").encode(), lower=True)[0]] + [int(perplexity.END)]
        held = zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
        texts.append((i, held, hashes))
    seen = collections.Counter(w for _, held, words in texts if not held for w in words)
    order = sorted({w for _, _, words in texts for w in words}, key=lambda w: (-seen[w].bit_length(), w))
    number = {w: k + 1 for k, w in enumerate(order)}
    count, customers = collections.Counter(), collections.Counter()
    for i, held, words in texts:
        for before, w in zip([0] + [number[x] for x in words], words):
            if not held:
                count[number[w], before] += 1
                customers[before] += 1
    rate = lambda counts: round(min(0.95, max(0.05, counts.count(1) / (counts.count(1) + 2 * counts.count(2)))), 3)
    d, up = rate(list(count.values())), rate(list(collections.Counter(w for w, _ in count).values()))
    base = 1 / (sum(n > 0 for n in seen.values()) + 1)
    draw = lambda key, c, others, p, disc: int(perplexity.draw_tables(perplexity._key(np.array([key[0]]), np.array([key[1]]), key[2]), np.array([c]), np.array([max(others, 0)]), np.array([p]), disc, 1.0)[0])
    tables, words = dict.fromkeys(count, 1), {w for w, _ in count}
    top, history = dict.fromkeys(words, 1), []
    parent = lambda w, mine, top, all_mine, all_top: (max(mine[w] - up * top.get(w, 0), 0) + (1 + up * all_top) * base) / (all_mine + 1)
    for sweep in range(perplexity.SWEEPS):
        mine, seats = collections.Counter(), collections.Counter()
        for (w, before), n in tables.items():
            mine[w] += n
            seats[before] += n
        all_mine, all_top = sum(mine.values()), sum(top.values())
        top = {w: draw((w, perplexity._SHARED, sweep), mine[w], all_top - top[w], base, up) for w in words}
        tables = {(w, b): n if (n := count[w, b]) == 1 else draw((w, b, sweep), n, seats[b] - tables[w, b], parent(w, mine, top, all_mine, all_top), d) for w, b in tables}
        history.append((tables, mine, top, all_mine, sum(top.values())))
    out = {}
    kept = history[perplexity.BURN_IN :]
    for at, (_, _, words_) in enumerate(texts):
        total = 0.0
        for before, w in zip([0] + [number[x] for x in words_], (number[x] for x in words_)):
            p = 0.0
            for tables, mine, top, all_mine, all_top in kept:
                seats = sum(n for (_, b), n in tables.items() if b == before)
                p += (count[w, before] - d * tables.get((w, before), 0) + (1 + d * seats) * parent(w, mine, top, all_mine, all_top)) / (customers[before] + 1)
            total += math.log10(p / len(kept))
        out[at] = total
    return out


def test_scores_are_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["the", "a", "of", f"w{rng.randrange(12)}"]) for _ in range(rng.randrange(12)))) for i in range(60)] + [(100, None), (102, "never seen words"), (103, "the of a")]
    plain = plain_scores(rows)
    for part, block in ((1 << 21, 1 << 20), (1 << 21, 60)):
        got = {r["doc_id"]: r["score"] for r in perplexity.score_texts(frame(spark, rows), part=part, block=block).collect()}
        assert max(abs(got[i] - plain[k]) for k, (i, _) in enumerate(rows)) < 1e-9


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 103), (101, 103)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100}
    assert components.components(links.filter("u < 0")).isEmpty()


def test_components_of_many_tasks(spark):
    """Whether one task contracts all edges or each a few, the roots are those of a union of sets, one link at a time."""
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 - i, 999 - i) for i in range(200)] + [(7, 7), (3, 5), (5, 3)]
    root = {x: x for pair in links for x in pair}
    for u, v in links:
        a, b = sorted((root[u], root[v]))
        root = {x: a if r == b else r for x, r in root.items()}
    want = {x: r for x, r in root.items() if any(x in pair and pair[0] != pair[1] for pair in links)}
    frame = spark.createDataFrame(links, "u long, v long").repartition(4)
    for most in (40, 1 << 20):
        assert {r["node"]: r["root"] for r in components.components(frame, most=most).collect()} == want, most


def test_a_url_limit_does_not_hang_on_the_size_of_the_corpus(spark):
    """Forty hosts a little apart: none goes, on few pages or many. One that is far worse does on both."""
    for n in (50, 100_000):
        rates = spark.range(41).select(F.concat("id", F.lit(".com")).alias("host"), F.when(F.col("id") < 40, 0.034 + F.col("id") * 0.0001).otherwise(0.4).alias("rate"))
        outcomes = rates.select("host", "rate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select("host", (F.col("k") < F.round(F.col("rate") * n)).cast("int").alias("bad"))
        pages = rates.select(F.col("host").alias("page_id"), F.concat(F.lit("http://"), "host").alias("url"))
        assert {r["page_id"] for r in urls.judge_urls(pages, outcomes).collect() if r["verdict"] == "block"} == {"40.com"}


def test_page_outcomes_and_shrinkage_decide(spark):
    """Words of urls and junk in texts label pages. A host of many bad pages goes; one bad page of two is no proof, though its own
    rate is far above the limit; a null page says nothing."""
    junk, clean = "<p>### *** $$$ word</p>", "<script>###</script><p>" + "word " * 60 + "### </p>"
    rows = [(i, f"http://h{i % 20}.com/{i}", clean) for i in range(200)] + [(300 + i, "http://the-casino.com/x", clean) for i in range(8)]
    rows += [(400 + i, "http://junk.com/x", junk) for i in range(8)] + [(500, "http://new.com/a", clean), (501, "http://new.com/Porn", clean), (502, "http://junk.com/", None), (503, "http://casinos.com/", clean)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    outcomes = urls.page_outcomes(pages)
    assert outcomes.filter("bad = 1").count() == 17 and outcomes.count() == len(rows) - 1
    out = {r["page_id"]: r for r in urls.judge_urls(pages, outcomes).collect()}
    assert {i for i, r in out.items() if r["verdict"] == "block"} == {*range(300, 308), *range(400, 408), 502}
    overall = urls.host_reputation(outcomes).first()["overall"]
    assert 0.5 / 0.5 > 2 * overall / (1 - overall) and out[500]["bad_rate"] < 0.5  # shrinkage turned it


def test_repeats_do_not_hang_on_ids(spark):
    """Null ids, one id for all, or one row for a third of all: many groups, and the same words go."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(50))
    rows = [" ".join(word() for _ in range(40)) + (" " + passage if k < 30 else "") for k in range(200)] + ["same words " * 3] * 100
    want = sorted(r["n_removed"] for r in substrings.drop_repeats(frame(spark, list(enumerate(rows)))).collect())
    for ids in ([None] * 300, [7] * 300, [*range(200), *[0] * 100]):
        docs = frame(spark, list(zip(ids, rows))).repartition(4)
        assert sorted(r["n_removed"] for r in substrings.drop_repeats(docs).collect()) == want and max(want) == 50
        sizes = groups.deal(docs.select("doc_id", "text"), 24).groupBy("g").count().count()
        assert sizes > 15


def test_urls(spark):
    cases = {
        "https://Blog.X.example.NET/en/1?a": ("blog.x.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/fr": ("example.net", "/fr", "net/", "block"), "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://a.org/fr/x#y": ("a.org", "/fr/x", "org/fr/", "allow"),
        "http://net": ("net", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "x://bad.com/a\nb": ("bad.com", "/a\nb", None, "block"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(0, next(iter(cases)))], "page_id long, url string")
    outcomes = spark.createDataFrame([("bad.com", 1)] * 200 + [("good.com", 0)] * 200 + [("new.com", 1), (None, 1), ("x.com", None)], "host string, bad int")
    out = urls.judge_urls(pages, outcomes).collect()
    assert len(out) == len(cases) + 1
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(cases.values())[r["page_id"]]
    # Two bad pages of three are no proof by themselves; on a domain whose other hosts are bad they are.
    few = [("a.x.com", 1)] * 2 + [("a.x.com", 0), ("a.y.com", 0)] + [("a.y.com", 1)] * 2
    rest = [(f"h{i}.{d}.com", int(i % 10 < bad)) for d, bad in (("x", 9), ("y", 1)) for i in range(60)] + [("z.com", 0)] * 300
    asked = spark.createDataFrame([(1, "http://a.x.com/"), (2, "http://a.y.com/"), (3, "http://new.com")], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in urls.judge_urls(asked, spark.createDataFrame(few + rest, "host string, bad int")).collect()}
    assert found == {1: "block", 2: "allow", 3: "allow"}
    hosts = ["a.b.co.uk:80", "b.co.uk", "x.y.com", "10.0.0.1:8080", "com", ""]
    parts = spark.createDataFrame([(h,) for h in hosts], "host string").select(*urls.registered_domain("host")).collect()
    assert [tuple(r) for r in parts] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("y.com", "com"), ("10.0.0.1", ""), ("com", "com"), ("", "")]
    clash = pages.selectExpr("*", "'x' as host", "'x' as path", "'x' as rule", "'x' as fit", "'x' as verdict", "'x' as bad_rate", "'x' as overall")
    assert sorted(map(str, urls.judge_urls(clash, outcomes).collect())) == sorted(map(str, out))
    rates = {r["host"]: r for r in urls.host_reputation(outcomes).collect()}
    assert rates["bad.com"]["rate"] > rates["new.com"]["rate"] > rates["good.com"]["rate"] and rates["new.com"]["sd"] > rates["bad.com"]["sd"]
    assert urls.judge_urls(pages.limit(0), outcomes.limit(0)).count() == 0
