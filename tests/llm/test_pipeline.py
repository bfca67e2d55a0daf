"""The pipeline against a plain version in Python, stage by stage and as a whole."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

import corpus_pipeline
from lattica.llm import char_model, line_dedup, mixing, quality
from lattica.llm.common import materialise

from .test_operators import brute_components, ids_of, water, words_of

PATH = "/root/testdata/sf0.001"


def plain_bits(texts):
    """A function giving the bits of a text under a model of ``texts``, n-gram by n-gram."""
    order = char_model.ORDER
    counts = [Counter()]
    for t in texts:
        x = [0] * (order - 1) + list(map(ord, t))
        counts[0].update(tuple(x[i : i + order]) for i in range(len(t)))
    for _ in range(order - 1):
        counts.append(Counter(g[1:] for g in counts[-1]))
    levels = []
    for c in counts:
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        d = [0] + [min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.1), i) if of[i] else 0.5 for i in (1, 2, 3)]
        total, kept = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kept[g[:-1]] += min(d[min(v, 3)], v)
        levels.append((c, d, total, kept))

    def prob(gram):
        p = 1 / char_model.ALPHABET
        for back, (c, d, total, kept) in zip(range(1, order + 1), reversed(levels), strict=True):
            g = gram[order - back :]
            if total[g[:-1]]:
                own = c.get(g, 0)
                p = (max(own - d[min(own, 3)], 0) + kept[g[:-1]] * p) / total[g[:-1]]
        return p

    def bits(t):
        x = [0] * (order - 1) + list(map(ord, t))
        return -sum(math.log2(prob(tuple(x[i : i + order]))) for i in range(len(t)))

    return bits


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def plain_quality(docs, labels):
    """(surely kept, in doubt by rounding) row numbers."""
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"]}
    known = [r for r in docs if r["doc_id"] in trusted]
    fold = lambda r: xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42) & 1
    halves = [plain_bits([r["text"] or "" for r in known if fold(r) != f]) for f in (0, 1)]
    cost = [halves[fold(r)](r["text"] or "") for r in known]
    mean = sum(cost) / sum(len(r["text"] or "") for r in known)
    smooth = lambda c, t: (c + quality.PRIOR_SYMBOLS * mean) / (len(t) + quality.PRIOR_SYMBOLS)
    by = defaultdict(list)
    for r, c in zip(known, cost, strict=True):
        by[r["lang"]].append(round(smooth(c, r["text"] or ""), 3))
    general, prior = quantile([b for v in by.values() for b in v], quality.QUANTILE) + quality.MARGIN, quality.PRIOR_DOCUMENTS
    limit = {k: (len(v) * (quantile(v, quality.QUANTILE) + quality.MARGIN) + prior * general) / (len(v) + prior) for k, v in by.items()}
    bits = plain_bits([r["text"] or "" for r in known])
    over = [smooth(bits(r["text"] or ""), r["text"] or "") - limit.get(r["lang"], math.inf) for r in docs]
    return {i for i, x in enumerate(over) if x <= 0.002}, {i for i, x in enumerate(over) if abs(x) <= 0.002}


def plain_line_dedup(docs):
    rule = line_dedup
    key = lambda r: ("n" if r["source"] is None else "S" + r["source"], r["text"] or "")
    rows, pages = Counter(map(key, docs)), Counter(key(r)[0] for r in docs)
    holders = defaultdict(set)
    for host, text in rows:
        for line in text.split("\n"):
            if line.strip(" "):
                holders[host, line].add(text)

    def order(host, text):
        h = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(host.encode(), 42))
        return h - (1 << 64) if h >> 63 else h

    drop = defaultdict(set)
    for (host, line), texts in holders.items():
        n = sum(rows[host, t] for t in texts)
        share, long = n / pages[host], len(re.split(r"\s+", line.strip(" "))) > rule.LONG_WORDS
        if n >= rule.MIN_PAGES and len(texts) > 1 and (long or share > rule.DOC_RATIO):
            keeper = min(texts, key=lambda t: order(host, t)) if share <= rule.RATIO else None
            for t in texts:
                if t != keeper:
                    drop[host, t].add(line)
    out = []
    for r in docs:
        lines = (r["text"] or "").split("\n")
        left = [x for x in lines if x not in drop[key(r)]]
        changed = len(left) < len(lines) and any(x.strip(" ") for x in left)
        out.append({**r, "text": "\n".join(left), "n_chars": len("\n".join(left))} if changed else r)
    return out


def plain_mix(docs):
    sizes, rows = Counter(), defaultdict(list)
    for r in docs:
        n = len(words_of(r["text"]))
        sizes[r["source"]] += n
        h = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[: mixing.BITS // 4], 16)
        rows[r["source"]].append((h, n, r))
    out = []
    for source, target in water(sizes).items():
        copies = math.floor(target / sizes[source]) if sizes[source] else 0
        rest, ahead, cut = target - copies * sizes[source], 0, -1
        for h in sorted({h for h, _, _ in rows[source]}):
            s = sum(n for x, n, _ in rows[source] if x == h)
            if ahead >= rest or ahead + s >= rest and 2 * ahead + s > 2 * rest:
                break
            ahead, cut = ahead + s, h
            if ahead >= rest:
                break
        for h, _, r in rows[source]:
            out += [r] * (copies + (h <= cut))
    return out


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def same(a, b):
    return Counter(map(repr, a)) == Counter(map(repr, b))


def test_pipeline_equals_a_plain_version(spark):
    docs, labels = spark.read.parquet(f"{PATH}/documents.parquet"), rows_of(spark.read.parquet(f"{PATH}/labels.parquet"))
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, PATH))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == columns, name
        seen.append((rows_of(docs), rows_of(out)))
        docs = out

    before, after = seen[0]
    kept, doubt = plain_quality(before, labels)
    got = {r["doc_id"] for r in after}
    assert {before[i]["doc_id"] for i in kept - doubt} <= got <= {before[i]["doc_id"] for i in kept | doubt} and 0.7 * len(before) < len(got) < len(before)
    assert same(plain_line_dedup(seen[1][0]), seen[1][1])
    before, after = seen[2]
    found = brute_components([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, n, c in found if n == 0 or d == c) and len(after) < len(before)
    assert same(plain_mix(seen[3][0]), seen[3][1])
    before, after = seen[4]
    want = Counter()
    for r in before:
        ids = ids_of(r["text"])
        for i in range(0, len(ids), 4096):
            want[r["doc_id"], i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[i : i + 4096]))] += 1
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, after)) == want
    bins = defaultdict(int)
    for r in after:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and len(bins) <= 1.05 * sum(bins.values()) / 4096 + 1
    assert Counter(map(key, rows_of(corpus_pipeline.run(spark, PATH)))) == want
