"""Spelling variants, HyperMinHash and fill-in-middle against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import fim, hyperminhash, ngrams, spelling
from lattica.llm.common import join_checked, materialise

from .test_operators import awkward, words_of

DOCS = "doc_id long, text string, n long, word string, key string, form string, registers string, output string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, *["clash"] * 5) for r in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(rows, least, drops):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % drops == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += len(run) >= least
    return counts


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least, count, times, drops):
    n = {w: c for w, c in plain_words(rows, least, drops).items() if c >= count}
    out = {}
    for w in n:
        near = [v for v in n if one_apart(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= times * n[w] else None
        out[w] = [n[w], len(near), form, n[form] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def spelt(rng, letters, words):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 14))) for _ in range(words)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 120)):
            w = list(base[min(int(rng.expovariate(0.2)), words - 1)])
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                kind = rng.random()
                if kind < 0.35:
                    del w[at]
                elif kind < 0.7:
                    w.insert(at, rng.choice(letters))
                else:
                    w[at] = rng.choice(letters)
            text.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((i, rng.choice([" ", "\n", "-"]).join(text)))
    return rows


@pytest.mark.parametrize("letters", ["ab", "abcdeéß×", "abcdefghijklmnopqrstuvwxyzàÿ"])
def test_spelling_variants_equal_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    rows = spelt(rng, letters, 40) + [(70, None), (71, ""), (72, "x" * 5000 + " " + "ab" * 3000), (None, "abcabc abcabd"), (73, "straße " * 9), (73, "straße " * 9)]
    rows += [rows[0]] * 4
    for least, count, times, drops in ((6, 5, 5, 199), (3, 1, 2, 3)):
        got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.spelling_variants(frame(spark, rows), least, count, times, drops).collect()}
        assert got == plain_variants(rows, least, count, times, drops)


def test_spelling_of_no_rows_and_awkward_ones(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    df, rows = awkward(spark)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.spelling_variants(df).collect()}
    assert got == plain_variants([r[:2] for r in rows], 6, 5, 5, 199)


def test_words_that_meet_on_a_key_are_few(spark):
    """All orders of the same letters meet within a window only, so groups stay small whatever the words are."""
    rng = random.Random(2)
    words = {"".join(rng.sample("abcdefghijkl", 12)) for _ in range(3000)}
    keys = spelling.near_keys(spark.createDataFrame([(w, 9) for w in words], "word string, n long"))
    assert keys.groupBy("length", "outside", "key").count().agg(F.max("count")).first()[0] <= 24


def plain_sets(rows, width):
    out = []
    for _, text in rows:
        w = words_of(lowered(text))
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def plain_components(rows, width=4):
    sets, ids = plain_sets(rows, width), [r[0] for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    one = lambda i: min((d for d in least[find(i)] if d is not None), default=None) if sets[i] else ids[i]
    return Counter((ids[i], len(s), one(i)) for i, s in enumerate(sets))


def near_rows(seed):
    """Short and long texts, each with edits of its own, and a passage that many unlike texts are mostly made of."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    texts = []
    for n in (3, 5, 8, 12, 30, 80, 300):
        for _ in range(4):
            base = [word() for _ in range(n)]
            for _ in range(6):
                own = list(base)
                for _ in range(rng.randint(0, max(1, n // 20))):
                    own[rng.randrange(n)] = word()
                texts.append(" ".join(own + [word() for _ in range(rng.randint(0, n // 10))]))
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(20)]) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates_equal_all_pairs(spark, small):
    rows = near_rows(small)
    got = hyperminhash.labelled(frame(spark, rows).repartition(3), small=small).collect()
    assert Counter((r["doc_id"], r["n"], r["component_id"]) for r in got) == plain_components(rows)


def test_near_duplicates_of_awkward_rows(spark):
    assert hyperminhash.near_duplicates(frame(spark, [])).count() == 0
    df, rows = awkward(spark)
    got = hyperminhash.near_duplicates(df).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components([r[:2] for r in rows])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_registers_estimate_similarity_and_chance():
    rng = np.random.default_rng(4)
    for n in (3, 40, 1000, 50_000):
        for share in (0.0, 0.5, 0.8, 1.0):
            both = round(2 * n * share / (1 + share))
            estimates = []
            for _ in range(8):
                x = ngrams.mixed(rng.integers(0, 1 << 63, 2 * n - both, np.uint64))
                one, two = (hyperminhash.registers(s, np.zeros(n, np.int64), 1)[0] for s in (x[:n], x[n - both :]))
                estimates.append(hyperminhash.estimate(one, two, n, n))
            assert abs(np.mean(estimates) - both / (2 * n - both)) < (0.2 if n == 3 else 0.06)
    # unlike registers of ten bits agree by chance about as often as is corrected for
    a, b = (hyperminhash.compressed(ngrams.mixed(rng.integers(0, 1 << 63, 400_000, np.uint64))) for _ in (0, 1))
    assert abs((a == b).mean() / hyperminhash._chance(2) - 1) < 0.2


UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_example(doc, text):
    text = text or ""
    u = UNIT.findall(text)
    x = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc, len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc, len(u), form, len(p), len(m), out


def fim_rows(seed):
    rng = random.Random(seed)
    pieces = ["abc", "Z", "<", ">", "<P", "S>", "é", "😀", "\n", " ", "12", "́", "x" * 3000]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return list(enumerate([*texts, None, "", "<P>", "a<M>b", "x" * 20_000, "ab c" * 20_000])) + [(3, "same id, other text"), (None, "no id")] * 2


def test_fill_in_middle_equals_a_plain_version_and_comes_back(spark):
    rows = fim_rows(1)
    made = fim.fill_in_middle(frame(spark, rows).repartition(3))
    got = fim.restored(made).collect()
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == Counter(plain_example(*r) for r in rows)
    assert Counter((r["doc_id"], r["restored"]) for r in got) == Counter((d, t or "") for d, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.digests(frame(spark, [])).count() == 0


def test_fill_in_middle_digests_of_awkward_rows(spark):
    df, rows = awkward(spark)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((*(e := plain_example(*r[:2]))[:5], sha(e[5]), sha(r[1] or "")) for r in rows)
    assert Counter(map(tuple, fim.digests(df).collect())) == want


def test_ropes_split_where_units_and_points_say():
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "c", " ", "é", "😀", "1"]) for _ in range(rng.randint(0, 40)))
        rope, units = fim.rope_of(text, leaf=rng.randint(1, 9)), UNIT.findall(text)
        assert fim.text_of(rope) == text and (rope.units if rope else 0) == len(units)
        for rank in (0, 1, len(units) // 2, len(units), len(units) + 3):
            left, right = fim.split(rope, rank)
            assert (fim.text_of(left), fim.text_of(right)) == ("".join(units[:rank]), "".join(units[rank:]))
            left, right = fim.split(rope, rank, "points")
            assert (fim.text_of(left), fim.text_of(right)) == (text[:rank], text[rank:])


def test_wide_rows_are_not_broadcast(spark):
    left = spark.range(1000).withColumnRenamed("id", "k")
    narrow = materialise(left.select("k", F.lit("x").alias("v")))
    wide = materialise(left.select("k", F.array_repeat(F.lit(1), 5000).alias("v")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda right, **more: join_checked(left, right, ["k"], "inner", **more)._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan(narrow, most=1 << 20)
        assert "strategy=broadcast" not in plan(wide, most=1 << 20) and "strategy=broadcast" not in plan(narrow, limit=999)
        assert join_checked(left, wide, ["k"], "inner", most=1 << 20).count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
