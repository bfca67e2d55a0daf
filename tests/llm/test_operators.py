"""The training-data operators against brute force, on small and awkward inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from lattica.llm import char_model, chat, exact_dedup, licenses, line_dedup, mixing, mpegts, ngram_join, packing, quality, sharding
from lattica.llm.common import heavy_keys, join_salted, materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, h string, rid string, name string, _bits string, cnt string"


def awkward(spark, empty=False):
    """Nulls, empty and blank texts, a long one, ties, repeated rows, and columns with names the operators use."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(300)]
    texts = [None, "", "  \n ", "One", "one  TWO\tthree", "one two three", " ".join(base), " ".join(base * 60), "x" * 9000, "<|endoftext|> a<|startoftext|>B, <|EndOfText|>!"]
    for i in range(40):
        words = base[:60] + [word() for _ in range(i % 7)]
        words[i % 60] = word()
        texts.append(" ".join(words))
    texts += texts[5:12] * 3
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4 if i % 5 else 0], len(t or ""), *["clash"] * 7) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id at all here now", "en", "a", 21, *["clash"] * 7)]
    return spark.createDataFrame([] if empty else rows, DOCS), [] if empty else rows


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_dedup_names_blocks_without_collisions(spark, docs):
    df, rows = docs
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    ids = defaultdict(list)
    for r in rows:
        ids[norm(r[1])].append(r[0])
    for block in (7, 4096):
        out = exact_dedup.exact_dedup(df, block).collect()
        assert len(out) == len(rows)
        want = Counter((r[0], min((i for i in ids[norm(r[1])] if i is not None), default=None), len(ids[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
        assert sum(r["kept"] for r in out) == len(ids)
        assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])


def test_exact_dedup_draws_again_when_keys_clash(spark, docs, monkeypatch):
    real, calls = exact_dedup.F.xxhash64, []

    def clash(*cols):
        calls.append(1)
        return F.lit(1).cast("long") if len(calls) <= 2 else real(*cols)

    monkeypatch.setattr(exact_dedup.F, "xxhash64", clash)
    out = exact_dedup.exact_dedup(docs[0])
    assert out.where("kept").count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in docs[1]})


def test_sharding_follows_the_tree_and_grows_into_the_new_shard(spark, docs):
    df, rows = docs
    out = sharding.shard_documents(df, 16).collect()
    assert Counter(r["size"] for r in out) == Counter(len((r[1] or "").encode()) + 1 for r in rows)
    assert Counter(r["text_crc32"] for r in out) == Counter(zlib.crc32((r[1] or "").encode()) for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({(r["doc_id"], r["shard"]) for r in out}) == len({r[0] for r in rows})


def test_sharding_moves_only_within_the_subtree_that_changed(spark):
    ids = spark.range(4000).withColumnRenamed("id", "k")
    place = lambda w: ids.select("k", sharding.shard_of(F.col("k"), sharding.tree(16, weights=w)).alias("s"))
    one, two = place({}), place({3: 2.0})
    moved = one.join(two.withColumnRenamed("s", "t"), "k").where("s <> t").collect()
    assert moved and all(r["t"] // 8 == 0 for r in moved)
    share = {r["s"]: r["count"] for r in place({}).groupBy("s").count().collect()}
    assert set(share) == set(range(16)) and max(share.values()) < 2 * min(share.values())
    assert 0 not in {r["s"] for r in place({0: 0.0}).collect()}


def plain_shard(key, node):
    """Descends with draws made again in Python, with seeds as chained hashes of columns have them; and the number of draws."""
    import struct

    import xxhash

    draws = 0
    while node.children:
        best = []
        for i, c in enumerate(c for c in node.children if c.load > 0):
            seed = xxhash.xxh64_intdigest(c.name.encode(), 42)
            h = seed if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed)
            best.append((-math.log(((h >> 11) + 0.5) / 2**53) / c.load, i, c))
        draws += len(best)
        node = min(best)[2]
    return node.shard, draws


def test_sharding_descends_the_tree(spark):
    keys = [*range(300), -1, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 3, 8, 16, 17, 29, 64):
        root = sharding.tree(shards, weights={1: 2.5, 2: 0.0})
        if root.load:
            got = {r["k"]: r["s"] for r in df.select("k", sharding.shard_of(F.col("k"), root).alias("s")).collect()}
            assert got == {k: plain_shard(k, root)[0] for k in keys}
    assert max(plain_shard(k, sharding.tree(64))[1] for k in keys) == 8 + 2 + 4  # a path, not all shards
    flat = sharding.tree(16, racks_per_region=1, shards_per_rack=16)
    assert any(plain_shard(k, flat)[0] != plain_shard(k, sharding.tree(16))[0] for k in keys)


def test_added_shards_take_rows_only_into_themselves(spark):
    ids = spark.range(2000).withColumnRenamed("id", "k")
    for planned in (1, 3, 8, 16, 17, 29):
        names = [f"s{n}" for n in range(planned, planned + 4)]
        rows = ids.select(*(sharding.shard_of(F.col("k"), sharding.tree(n, planned=planned)).alias(f"s{n}") for n in range(planned, planned + 4))).collect()
        for one, two, new in zip(names, names[1:], range(planned, planned + 3), strict=False):
            moved = [r[two] for r in rows if r[one] != r[two]]
            assert moved and set(moved) == {new}


def test_mixing_buckets_at_sixty_bits(spark):
    """Hashes just below a bucket's edge belong to the bucket before it."""
    hashes = [80 * 2**48 + 1, 4000 * 2**48 - 1, 4000 * 2**48 + 5, 4090 * 2**48]
    rows = materialise(spark.createDataFrame([("Sa", h, 10) for h in hashes], "skey string, h long, size long"))
    for target, taken in ((5.0, 1), (15.0, 2), (25.0, 3), (28.0, 3), (36.0, 4)):
        r = mixing.thresholds(rows, spark.createDataFrame([("Sa", 40, target)], "skey string, source_size long, target double")).first()
        assert r["copies"] == 0 and sum(h < r["threshold"] for h in hashes) in (taken - 1, taken), (target, r)
        assert abs(10 * sum(h < r["threshold"] for h in hashes) - target) <= 5


def water(sizes):
    """Targets by repeated sharing of what is above a cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_meets_targets(spark, docs):
    df, rows = docs
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    want = water(sizes)
    at = {}
    for r, o in zip(sorted(rows, key=repr), sorted(out, key=lambda o: repr((o["doc_id"],))), strict=True):
        at.setdefault((o["source_size"], round(o["target"], 6)), 0)
        at[(o["source_size"], round(o["target"], 6))] += o["taken"]
        assert o["taken"] <= 2 * o["size"] and (o["size"] == 0 or o["taken"] % o["size"] == 0)
    assert {k for k in at} == {(sizes[s], round(want[s], 6)) for s in sizes}
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(repr, again)) == Counter(map(repr, out))
    longest = max(len(words_of(r[1])) for r in rows)
    assert all(abs(v - k[1]) <= 2 * longest for k, v in at.items())
    grown = mixing.mixed_documents(df)
    assert grown.columns == df.columns
    assert grown.count() == sum(o["times"] for o in out)


@lru_cache
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(text):
    return plain_tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_covers_every_token_once(spark, docs):
    df, rows = docs
    for capacity in (64, 4096):
        out = packing.pack_documents(df, capacity=capacity).collect()
        want = Counter()
        for r in rows:
            ids = ids_of(r[1])
            for i in range(0, len(ids), capacity):
                own = ids[i : i + capacity]
                want[(r[0], i // capacity, i, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
        bins = defaultdict(list)
        for r in out:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        tokens = sum(k[3] * v for k, v in want.items())
        assert len(bins) <= -(-tokens // capacity) * 1.1 + 1


def test_word_tokenizer_equals_the_whole_text():
    tok = packing.WordTokenizer(packing.default_tokenizer())
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", "É", " ", "\n", "\t", "'s", "12", ".", ",", "!!", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "́", "ﬁ", "Σ", "İ", "日本", "🙂", ";", ":"]) for _ in range(rng.randint(0, 40)))
        want = plain_tokenizer().encode(text, add_special_tokens=False).ids
        assert tok(text) == b"".join(x.to_bytes(4, "little") for x in want), repr(text)


def test_fullest_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(200):
        counts = Counter(rng.randint(1, 12) for _ in range(rng.randint(1, 8)))
        room = rng.randint(0, 30)
        sums = {0}
        for n in counts.elements():
            sums |= {s + n for s in sums}
        got = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert not Counter(got) - counts


def test_chat_round_trip(spark):
    says = f"{chat.END}{chat.START}assistant ok"
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", says), (1, 2, "user", "<\\|im_end|> <|"), (2, 0, "system", None), (3, 1, "assistant", "late"), (3, 0, None, "first"), (3, 2, "assistant", ""),
            (None, 0, "user", "x"), (4, 0, "assistant", "<"), (4, 0, "assistant", "<"), (5, 0, "ro\nle\\n", "|"), (5, None, "assistant", "é🙂")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert set(out) == set(groups)
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[1] is None, r[1], r[2] or "", r[3] or ""))
        pairs = [(r[2] or "", r[3] or "") for r in turns]
        said = "".join(t for r, t in pairs if r == "assistant")
        got = out[conv]
        assert got["n_turns"] == len(pairs)
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in pairs).encode()).hexdigest()
        assert (got["loss_chars"], got["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        written, total = "", 0
        for i, (r, t) in enumerate(pairs):
            written += chat.turn_string(r, t)
            total += len(written) if r == "assistant" or i == len(pairs) - 1 else 0
        assert got["formatted_chars"] == total
    assert chat.format_conversations(df.limit(0)).count() == 0
    assert all(chat.unescape(chat.escape(t)) == t for t in (says, "<\\|", "<\\\\|", "<|<|", "\\<|", "<"))


def test_transport_stream_round_trip(spark, docs):
    df, rows = docs
    out = mpegts.store_texts(df, keep_media=True).collect()
    want = []
    for r in rows:
        data = (r[1] or "").encode()
        payload = data.ljust(max(576, -(-len(data) // 576) * 576), b"\xff")
        want.append((r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == Counter(want)
    for r in out:
        assert r["media_bytes"] == len(r["media"]) and r["media_bytes"] % 188 == 0 and r["feature"].endswith("errors=0")


def plain_stream(media):
    """(payload, timestamps, random-access units) by the published layout, packet by packet."""
    assert len(media) % 188 == 0
    pids, tables = {}, {}
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47
        pid, start, control, counter = (p[1] & 31) << 8 | p[2], p[1] >> 6 & 1, p[3] >> 4 & 3, p[3] & 15
        body, flags = 4, 0
        if control & 2:
            flags = p[5] if p[4] else 0
            body = 5 + p[4]
        if pid not in pids:
            pids[pid] = []
        elif pid >= 32:
            assert counter == (pids[pid][-1][3] + 1) % 16
        pids[pid].append((start, flags, p[body:], counter))
    for pid, table in ((0, 0),):
        raw = pids[pid][0][2]
        section = raw[1 + raw[0] :]
        assert section[0] == table
        tables["pmt"] = (section[10] & 31) << 8 | section[11]
    raw = pids[tables["pmt"]][0][2]
    section = raw[1 + raw[0] :]
    es = (section[8 + 5] & 31) << 8 | section[8 + 6]
    units = []
    for start, flags, body, _ in pids[es]:
        if start:
            units.append([flags >> 6 & 1, b""])
        units[-1][1] += body
    payload, stamps = b"", []
    for _, u in units:
        assert u[:3] == b"\0\0\1" and int.from_bytes(u[4:6], "big") == len(u) - 6
        t = u[9:14]
        stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        payload += u[9 + u[8] :]
    return payload, stamps, [i for i, (r, _) in enumerate(units) if r]


def test_transport_stream_read_by_another_reader(spark, docs):
    texts = {r[0]: (r[1] or "").encode() for r in docs[1]}
    for r in mpegts.store_texts(docs[0], keep_media=True).where("doc_id is not null").collect():
        payload, stamps, starts = plain_stream(bytes(r["media"]))
        assert payload.rstrip(b"\xff") == texts[r["doc_id"]] and len(payload) == r["payload_bytes"]
        assert (stamps, starts) == (r["timestamps"], r["random_access"])


def test_transport_stream_sees_damage():
    payload = bytes(range(256)) * 200
    media = bytearray(mpegts.mux(payload))
    got = mpegts.demux(bytes(media))
    assert got.payload == payload and got.errors == 0 and len(got.timestamps) == 6 and got.random_access == [0, 4]
    assert got.timestamps == [i * mpegts.TICKS for i in range(6)]
    media[188 * 4 + 3] ^= 1
    assert mpegts.demux(bytes(media)).errors == 2
    media[10] ^= 1
    with pytest.raises(ValueError):
        mpegts.demux(bytes(media))


def brute_components(rows):
    def shingles(text):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def test_jaccard_components_equal_all_pairs(spark, docs, monkeypatch):
    df, rows = docs
    want = brute_components(rows)
    for small, batch in ((32, 1_000_000), (2, 700)):
        monkeypatch.setattr(ngram_join, "SMALL", small)
        monkeypatch.setattr(ngram_join, "BATCH_ENTRIES", batch)
        out = ngram_join.jaccard_components(df).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want


def test_jaccard_components_of_random_families(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    rng = random.Random(11)
    rows = []
    for family in range(6):
        base = [f"w{rng.randint(0, 40)}" for _ in range(rng.choice([4, 12, 60, 150]))]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 500)}"
            rows.append((len(rows), " ".join(words)))
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows)


def test_one_of_each_keeps_the_smallest(spark, docs):
    df, rows = docs
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    want = {d for (d, n, c) in brute_components(rows) if d is not None and (n == 0 or d == c)}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(want)


def test_one_of_each_judges_texts_that_share_a_doc_id(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (3, c)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.one_of_each(df).collect())) == [(1, a), (2, b), (3, c)]


def test_rows_of_heavy_keys_find_their_partner(spark):
    left = materialise(spark.createDataFrame([(1, i) for i in range(3000)] + [(i, 1) for i in range(1, 40)], "a long, b long"))
    right = spark.createDataFrame([(i, f"r{i}") for i in range(30)], "a long, said string")
    heavy = heavy_keys(left, "a")
    assert [r["a"] for r in heavy.collect()] == [1]
    out = join_salted(left, right, "a", heavy, F.col("b")).collect()
    assert Counter(map(tuple, out)) == Counter((a, b, f"r{a}") for a, b in map(tuple, left.collect()) if a < 30)


def test_license_scan(spark):
    filler = "some words here that say nothing of interest at all . " * 30
    rows = [(1, f"{filler}\nReleased under the MIT License."), (2, "Released  under the\tMIT license.\nReleased under the MIT License.\n" + filler), (3, filler), (4, None), (5, ""),
            (6, "Licensed under the new Apache License, Version 2.0."), (7, "MIT " + filler + " License"), (8, "This work is licensed under the GNU General Public License, version 3." * 2)]
    found = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, "MIT"), (2, "MIT"), (6, "Apache-2.0"), (8, "GPL-3.0")}


def test_patience_alignment_is_increasing_and_windows_lose_nothing():
    rng = random.Random(4)
    template = [f"t{i}" for i in range(20)]
    for _ in range(100):
        inside = [w for w in template if rng.random() > 0.1]
        text = [f"x{rng.randint(0, 9)}" for _ in range(200)]
        text[50:50] = inside
        pairs = licenses.align(text, template)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False)) and all(text[t] == template[m] for m, t in pairs)
        assert len(pairs) == len(inside)
        if len(inside) >= 16:
            assert licenses.scan(" ".join(text), {"T": template})
    values = [rng.randint(0, 50) for _ in range(40)]
    kept = [values[i] for i in licenses.longest_increasing(values)]
    assert kept == sorted(set(kept))


def test_scan_finds_what_whole_alignment_finds(spark):
    """Every text whose whole alignment covers a notice is reported with that coverage at least, wherever words are put in."""
    rng = random.Random(6)
    templates = {k: licenses.words(v) for k, v in licenses.NOTICES.items()}
    rows, want = [], {}
    for i in range(150):
        name = rng.choice(list(templates))
        said = [w for w in templates[name] if rng.random() > rng.choice([0, 0.1, 0.25])]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(said) + 1)
            said[at:at] = [f"x{rng.randint(0, 30)}" for _ in range(rng.choice([1, 20, 200]))]
        text = " ".join(said)
        rows += [(i, text, "clash")] * (1 + i % 2)
        for k, t in templates.items():
            if (n := len(licenses.align(licenses.words(text), t))) >= licenses.COVERAGE * len(t):
                want[i, k] = n
    rows += [(900, " ".join(licenses.NOTICES.values()) + " filler" * 50_000, "clash"), (None, licenses.NOTICES["MIT"], "clash")]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    got = Counter((r["doc_id"], r["license"]) for r in out)
    assert len(want) > 80 and all(got[i, k] == 1 + i % 2 for i, k in want)
    assert all(r["aligned"] >= want.get((r["doc_id"], r["license"]), 0) and r["coverage"] >= licenses.COVERAGE for r in out)
    assert got[None, "MIT"] == 1 and {k for i, k in got if i == 900} == set(templates)


def test_repeated_notices_are_found_at_any_distance():
    mit = licenses.words(licenses.NOTICES["MIT"])
    found = licenses.scan("see Released under the MIT License here and Released under the MIT License there", {"MIT": mit})
    assert found == [("MIT", 1.0, 1, 5, 5)]
    for name, notice in licenses.NOTICES.items():
        template = licenses.words(notice)
        if len(template) > 40:
            continue
        for gap in range(0, 7 * len(template), max(1, len(template) // 4)):
            for copies in (2, 3):
                text = ["head", *(x for i in range(copies) for x in [*template, *(f"x{i}y{j}" for j in range(gap))]), "tail"]
                assert licenses.scan(" ".join(text), {name: template}) == [(name, 1.0, 1, len(template), len(template))], (name, gap, copies)


def test_line_dedup_by_site(spark):
    page = lambda body, foot: f"<html><head><style>p{{}}</style></head><body><nav><li>Home</li></nav><p>{body}</p><div class='f'>{foot}</div><!-- {body} --></body></html>"
    rows = [(i, f"https://A.example.com/{i}", page(f"unique {i}", "All rights" if i % 2 else f"foot {i}")) for i in range(10)]
    rows += [(20, "http://b.example.com/", page("alone", "All rights")), (21, None, None), (22, "no host", page("x", "y"))]
    out = {r["page_id"]: r for r in line_dedup.dedup_pages(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string"), ratio=0.45, min_pages=3).collect()}
    assert out[1]["text"] == "unique 1" and out[1]["n_dropped"] == 2
    assert out[2]["text"] == "unique 2\nfoot 2" and out[20]["text"] == "Home\nalone\nAll rights"
    assert out[21]["text"] == "" and out[21]["n_lines"] == 0 and out[22]["host"] == ""


def test_line_dedup_of_documents_keeps_whole_copies(spark):
    rows = [(i, f"line {i}\nshared\n\nend {i}", "en", "s", 0) for i in range(8)] + [(9, "shared", "en", "s", 6), (10, None, "en", "s", None), (11, "", "en", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in line_dedup.dedup_documents(df, ratio=0.5).collect()}
    assert out[3]["text"] == "line 3\n\nend 3" and out[3]["n_chars"] == len("line 3\n\nend 3")
    assert out[9]["text"] == "shared" and out[10]["text"] is None and out[11]["text"] == ""
    assert len(out) == len(rows)


def test_line_dedup_of_documents_removes_passages_of_a_large_source(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    text = lambda i: "\n".join([f"own {i}", *[passage] * (i in (5, 900, 1700)), *["notice"] * (i % 400 == 0), *["seldom"] * (i < 2), *["footer"] * (i % 5 == 0), f"end {i}"])
    rows = [(i, text(i), "s") for i in range(2000)] + [(3000 + i, f"copy\n{passage} more\nlast", "t") for i in range(4)]
    out = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    holds = lambda line: sum(line in x for x in out.values())
    assert holds(passage) == 1 and holds("notice") == 1 and holds("seldom") == 2 and holds("footer") == 0
    assert all(f"own {i}" in out[i] and f"end {i}" in out[i] for i in range(2000))
    assert all(len(out[3000 + i]) == 3 for i in range(4))


def test_character_model_in_shards_matches_a_plain_version(spark, monkeypatch):
    import pyarrow as pa

    said, order = ["the cat sat. The hat", "кот спит, кот", "a different Line", ""], char_model.ORDER
    counts = char_model.count_ngrams(spark.createDataFrame([(t, 0) for t in said], "text string, fold int"))
    plain = [Counter(tuple(x[i : i + order]) for t in said for x in [[0] * (order - 1) + list(map(ord, t))] for i in range(len(t)))]
    assert {tuple(r)[1:-1]: r["n"] for r in counts.collect()} == plain[0]
    for _ in range(order - 1):
        plain.append(Counter(g[1:] for g in plain[-1]))

    def prob(gram, level=0):
        if level == order:
            return 1 / char_model.ALPHABET
        of, lower = Counter(plain[level].values()), prob(gram[1:], level + 1)
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        d = [0] + [min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.1), i) if of[i] else 0.5 for i in (1, 2, 3)]
        same = [v for g, v in plain[level].items() if g[:-1] == gram[:-1]]
        own = plain[level].get(gram, 0)
        return (max(own - d[min(own, 3)], 0) + sum(min(d[min(v, 3)], v) for v in same) * lower) / sum(same) if same else lower

    table, base = char_model.build(counts.drop("fold").selectExpr("2 AS model", "*"))
    asked = ["the cat", "кот", "THE!", "x", "", "спит. Line", "the cat", "ab" * 3000]
    want = [-sum(math.log2(prob(tuple(x[i : i + order]))) for x in [[0] * (order - 1) + list(map(ord, t))] for i in range(len(t))) for t in asked]
    df = spark.createDataFrame([(i, t, 2, 2 if i % 2 else None) for i, t in enumerate(asked)], "i int, text string, m int, m2 int").repartition(3)
    monkeypatch.setattr(char_model, "AT_ONCE", 7)
    monkeypatch.setattr(char_model, "PER_COPY", 2000)
    outs = []
    for shard, ask, sample, most in ((60, 5, 100, 50), (10**6, 10**6, 100, 10**6), (60, 10**6, 0, 0)):
        monkeypatch.setattr(char_model, "SHARD", shard)
        monkeypatch.setattr(char_model, "ASK", ask)
        got = {r["i"]: r for r in char_model.scored(df, table, base, ["m", "m2"], 0, sample, most).collect()}
        assert sorted(got) == list(range(len(asked)))
        for i, (t, bits) in enumerate(zip(asked, want, strict=True)):
            assert abs(got[i]["_bits0"] - bits) < 1e-4 * (len(t) + 1) and got[i]["_symbols"] == len(t)
            assert got[i]["_bits1"] == (got[i]["_bits0"] if i % 2 else None)
        outs.append({i: r["_bits0"] for i, r in got.items()})
    assert outs[0] == outs[1] == outs[2]


def test_classifier_tells_gibberish_from_prose_beyond_ascii(spark):
    rng = random.Random(3)
    words = "мама мыла раму кошка сидит на окне вечером дождь идет над старым городом".split()
    prose = lambda: " ".join(rng.choice(words) for _ in range(60))
    junk = lambda: " ".join("".join(rng.choice("бвгджзклмнпрстфхцчшщ") for _ in range(rng.randint(2, 7))) for _ in range(60))
    rows = [(i, prose(), "ru") for i in range(120)] + [(200 + i, junk(), "ru") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.classify(docs, labels).where("keep").collect()}
    assert kept >= set(range(100)) and not kept & set(range(200, 220))


def test_classifier_on_held_out_labels(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    out = quality.classify(docs, fit).join(held, "doc_id").collect()
    good = [r["keep"] for r in out if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["keep"] for r in out if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.3


def test_classifier_keeps_languages_without_trusted_text_and_draws_small_ones_to_all(spark):
    rng = random.Random(9)
    prose = lambda: " ".join(rng.choice("the cat sat on a mat and saw the dog run over a hill".split()) for _ in range(50))
    rows = [(i, prose(), "en" if i < 60 else "de", "clash") for i in range(70)] + [(100 + i, "zqxj vkwp " * 20, lang, "clash") for i, lang in enumerate(["en", "xx", None, "de"])] * 2
    labels = spark.createDataFrame([(i, 1, 0) for i in range(70)], "doc_id long, quality int, toxic int")
    out = quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string, _limit string"), labels).collect()
    assert len(out) == len(rows)
    kept = defaultdict(set)
    for r in out:
        kept[r["doc_id"]].add(r["keep"])
    assert [kept[100 + i] for i in range(4)] == [{False}, {True}, {True}, {False}]
    assert sum(kept[i] == {True} for i in range(70)) >= 68
    again = quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string, _limit string").repartition(5), labels).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_classifier_on_awkward_rows(spark, docs):
    df, rows = docs
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(0, 40, 2)] + [(None, 1, 0, "x"), (3, 0, None, "x")], "doc_id long, quality int, toxic int, text string")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and 0 < kept.count() <= len(rows)
    assert quality.classify(df, labels.limit(0)).where("keep").count() == len(rows)


def test_empty_tables(spark):
    df, _ = awkward(spark, empty=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (exact_dedup.exact_dedup(df), sharding.shard_documents(df), mixing.mix(df), packing.pack_documents(df), mpegts.store_texts(df), ngram_join.jaccard_components(df), licenses.scan_licenses(df),
                quality.classify(df, labels), line_dedup.dedup_documents(df), line_dedup.dedup_pages(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert out.count() == 0
