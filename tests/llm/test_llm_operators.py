"""Each training-data operator against brute force on a small fixture with nulls, empties, ties, repeats and long texts."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillflow.llm import ann, bpe, bundles, exact, lines, mixing, simhash, suffix, tokens, toxicity, windows
from quillflow.llm.components import components
from quillflow.llm.queries import tokenizer

DOC = "doc_id long, text string, source string, sha string, bundle int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rng.randint(5, 120)) for _ in range(40)]
    passage, out = text(60), []
    for k in range(40):
        out.append((k, base[k] + ("\n" + passage if k % 4 == 0 else ""), f"s{k % 3}"))
    out += [(100 + k, base[k], "s0") for k in range(8)]
    out += [(200 + k, base[k] + " x", None) for k in range(8)]
    out += [(None, "a b " * 20, "s1"), (300, None, "s1"), (301, "", None), (302, "a b " * 20, "s2"), (303, "A B " * 20, "s2"), (304, "é 日本 " * 90, "s1")]
    out += [(305, "same", "s1"), (305, "same", "s1"), (306, "q" * 3000, "s1"), (-7, base[3], "s1"), (307, "\x0b\t \n", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], DOC)


def got(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def strings(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def classes(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("chunk", [8192, 3])
def test_simhash(docs, rows, chunk):
    prints = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    group, least = classes(len(rows), pairs), {}
    for (i, *_), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = strings((i, f"{p:016x}", least.get(g)) for (i, *_), p, g in zip(rows, prints, group))
    assert got(simhash.near_duplicates(docs, chunk=chunk), "doc_id", "fingerprint", "component_id") == want


def test_bit_sliced_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, np.uint64)
    fps = np.unique(np.concatenate([base, base[:80] ^ np.uint64(1 << 40), base[:40] ^ np.uint64(0b11111), base[:40] ^ np.uint64(0b1111 << 20)]))
    n = len(fps)
    for radius in (0, 3, 4, 6, 11, 21):
        a, b = simhash.near_links(fps, np.arange(1, n + 1), np.full(n, n), radius)
        pairs = [(i, j) for i in range(n) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= radius]
        assert classes(n, pairs) == classes(n, zip(a.tolist(), b.tolist()))


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {k: 1 for k in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    want = strings((i, len((t or "").encode()), size(t or ""), size(t or "") > 10) for i, t, _ in rows)
    assert got(tokens.count_tokens(docs, tokenizer("word_bpe_49k.json"), limit=10), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_token_transducer_on_odd_texts(monkeypatch):
    import json

    from tokenizers import Tokenizer

    rng, path = random.Random(2), tokenizer("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), tokens.Transducer(json.load(open(path)))
    texts = ["don't 's ''s !'s a's've x'll 'RE 12", "<|endoftext|>a <|startoftext|>", "a" * 999, "İΣ ΑΣ ß é"]
    texts += ["".join(rng.choice("ab '\n\tsrelvt1!é  hingoEAdu") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for n in (1024, 1025, 1537, 2000, 50_000):  # words of several chunks, last and not last
        word = "".join(rng.choice("abcdeinot") for _ in range(n))
        texts += ["x" * n, f"a {word}", f"{word} b {word}!", word + "1é" + word]
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(chr(rng.choice(every)) for _ in range(40)) for _ in range(300)]
    monkeypatch.setattr(tokens, "PIECE", 3000)
    monkeypatch.setattr(tokens, "STATES", 2000)
    assert list(own.count(texts)) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_line_dedup(spark):
    line = lambda k: f"line number {k} of a text, long enough to edit"
    far = ["entirely other words stand in this line here", "and nothing of the kind was written before it"]
    data = [
        (1, "\n".join([far[0], "", line("x"), "short"])), (2, "\n".join([line("y"), far[0], "short", "shorT", ""])), (3, far[1] + "\n" + far[1][:20] + far[1][21:]),
        (None, far[1]), (4, None), (5, ""), (6, "\n \n"), (7, "z" * 30 + "\n" + "z" * 31 + "\n" + "z" * 33), (-1, "short"), (8, line("xyz")),
    ]
    df = spark.createDataFrame([(i, t, 9) for i, t in data], "doc_id long, text string, n_lines int")
    want = strings([
        (1, far[0] + "\n\n" + line("x"), 1), (2, "shorT\n", 3), (3, far[1], 1), (None, "", 1), (4, None, 0), (5, "", 0), (6, "\n \n", 0),
        (7, "z" * 30 + "\n" + "z" * 33, 1), (-1, "short", 0), (8, line("xyz"), 0),
    ])
    assert got(lines.dedup_lines(df), "doc_id", "text", "n_removed") == want


def test_line_dedup_at_random(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randint(14, 22))) for _ in range(25)]

    def edit(x):
        k = rng.randrange(len(x))
        return rng.choice([x[:k] + "b" + x[k + 1 :], x[:k] + x[k + 1 :], x[:k] + "é" + x[k:]])

    data = [(k, "\n".join(edit(edit(rng.choice(pool))) if rng.random() < 0.3 else edit(rng.choice(pool)) for _ in range(4))) for k in range(40)]

    def one_edit(a, b):
        return a == b or any(a[:k] + a[k + 1 :] == b[:k] + b[k + (len(a) == len(b)) :] for k in range(len(a))) if len(a) - len(b) in (0, 1) else len(b) - len(a) == 1 and one_edit(b, a)

    first = {}
    for i, t in data:
        for n, x in enumerate(t.split("\n")):
            if x.strip(" \t\r"):
                first.setdefault(x, (i, n))
    gone = {x for x in first if len(x) >= 16 and any(first[y] < first[x] and len(y) >= 16 and one_edit(x, y) for y in first if y != x)}
    want = strings((i, sum(bool(x.strip()) and (first[x] != (i, n) or x in gone) for n, x in enumerate(t.split("\n")))) for i, t in data)
    assert got(lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "n_removed") == want and gone


def test_nearest(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    data = [(k, x.tolist()) for k, x in enumerate(v)]
    bad = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (None, v[0].tolist()), (904, [1.0]), (5, v[5].tolist())]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in range(0, 600, 20):
        score = v @ v[q]
        score[q] = -9
        best = np.lexsort((np.arange(600), -score))[:20]
        mine = [found[q][k] for k in range(1, 21)]
        assert all(abs(score[i] - s) < 1e-12 for i, s in mine) and mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in mine} & set(best.tolist()))
    assert len(found) == 30 and hits / 600 >= 0.9
    few = spark.createDataFrame([(0, [3.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 3.0), (0, 2, 2, 3.0)]


def test_mixing(docs, rows):
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (_, t, _) in enumerate(rows)}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[k] for k, r in enumerate(rows) if r[2] == s) for s in names}
    target, open_, rest = {}, list(names), 1.5 * sum(size.values())
    weight = dict(zip(names, (3, 1, 2, 3)))
    while over := [s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * own[s]]:
        target |= {s: 2.0 * own[s] for s in over}
        rest -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
    out = mixing.mix_report(docs)
    assert got(out, "doc_id", "size", "source_size") == strings((i, size[k], own[s]) for k, (i, _, s) in enumerate(rows))
    found = out.join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    for r in found:
        assert abs(r["target"] - target[r["source"]]) < 1e-6
    taken = {}
    for r in out.join(docs.select("doc_id", "text", "source").distinct(), "doc_id").collect():
        if r["doc_id"] != 305:  # its rows are one to the join
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in target.items():  # what is open is less than the next rows of a source, here of at most 450 words
        assert t - 200 <= taken.get(s, 0) <= t + 1
    assert out.filter("taken > 2 * size").count() == 0 and got(out, *out.columns) == got(mixing.mix_report(docs), *out.columns)
    mixed = mixing.mix(docs, F.array("source"))
    assert mixed.columns == docs.columns and mixing.n_words is not None
    assert mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == out.agg(F.sum("taken")).first()[0]


def test_mixing_overlapping_sources():
    flow = mixing.route([(("a",), 10), (("a", "b"), 10), (("b",), 0)], {"a": 12, "b": 8}, 2)
    assert flow == {(0, "a"): 10, (1, "a"): 2, (1, "b"): 8}
    twice = mixing.route([(("a",), 10), (("b",), 10)], {"a": 15, "b": 30}, 2)
    assert twice == {(0, "a"): 15, (1, "b"): 20}


def test_mixing_of_arrays_of_sources(spark):
    """Documents of one and of two sources, end to end: every source comes near its quota, no document is used over twice."""
    rng = random.Random(8)
    data = [(k, " ".join(["w"] * rng.randint(1, 9)), rng.choice([["a"], ["b"], ["a", "b"], ["c"], ["b", "a", "a"]])) for k in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, tags array<string>")
    mixed = mixing.mix(df, F.col("tags"), weights=(1, 1, 2), share=1.2)
    words = sum(len(t.split()) for _, t, _ in data)
    uses = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    size = {k: len(t.split()) for k, t, _ in data}
    c = sum(size[k] for k, _, s in data if s == ["c"])
    of_c = sum(size[k] * uses.get(k, 0) for k, _, s in data if s == ["c"])
    assert max(uses.values()) <= 2 and of_c == 2 * c  # its share is more than twice its words
    rest = sum(size[k] * uses.get(k, 0) for k, _, s in data if s != ["c"])
    assert abs(rest - (1.2 * words - 2 * c)) <= 12


def test_flow_of_many_sources():
    rng = random.Random(2)
    patterns = [((f"s{k}",), rng.randint(1, 99)) for k in range(3000)] + [((f"s{rng.randrange(1500)}", f"s{1500 + rng.randrange(1500)}"), rng.randint(1, 99)) for _ in range(3000)]
    flow = mixing.route(patterns, {f"s{k}": 60 for k in range(3000)}, 2)
    used, got_ = {}, {}
    for (k, s), v in flow.items():
        used[k], got_[s] = used.get(k, 0) + v, got_.get(s, 0) + v
    assert all(v <= 2 * patterns[k][1] for k, v in used.items()) and all(v <= 60 for v in got_.values())
    assert sum(got_.values()) > 0.9 * 60 * 3000


def test_byte_bpe(docs, rows):
    import public_tokenizers
    import tiktoken

    path = tokenizer("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [lib.encode_ordinary(t or "") for _, t, _ in rows]
    want = strings((i, len(x), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for (i, t, _), x in zip(rows, ids))
    assert got(bpe.digest(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    both = bpe.decode(bpe.encode(docs, path, offsets=True), path)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both.collect())
    model, rng = bpe.Ranks(open(path, "rb").read()), random.Random(1)
    odd = ["  \n  ", "\n\n foo", "'re'S'", "a" * 300] + ["".join(rng.choice("ab '\n\tsrelv1!é  ") for _ in range(rng.randint(0, 50))) for _ in range(500)]
    assert [[i for c in codes for i in c[0]] for codes, _ in bpe.encode_batch(odd, model)] == [lib.encode_ordinary(t) for t in odd]


def test_toxicity(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfglmnprt") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    bad = ["grzkwort", "zwifflex", "qworgish"]
    data, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        text = [rng.choice(words) for _ in range(40)] + ([rng.choice(bad)] * 2 if toxic else [])
        rng.shuffle(text)
        data.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    data += [(1000, "pala grzkworten " + " ".join(words[:10])), (1001, None), (1002, ""), (None, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(df, known).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(out[k]["held_out"] == (k in set(held)) for k in range(900))
    assert sum(out[k]["predicted"] == (k % 3 == 0) for k in held) / len(held) > 0.97
    assert out[1000]["predicted"] == 1 and all(0 <= r["score"] <= 1 for r in out.values()) and None in out
    assert toxicity.without_toxic(df, known).filter("doc_id % 3 = 0 and doc_id < 900").count() < 20
    assert toxicity.toxicity(df, known.limit(0)).filter("predicted <> 0").count() == 0


def test_windows(monkeypatch, docs, rows):
    monkeypatch.setattr(bundles, "BUNDLE_BYTES", 4000)
    monkeypatch.setattr(windows, "SHARD_WINDOWS", 500)
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t, _ in rows]
    first = {}
    for (i, *_), w in zip(rows, split):
        for k in range(len(w) - 12 if i is not None else 0):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    want = []
    for (i, *_), w in zip(rows, split):
        gone = [False] * len(w)
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    assert got(windows.repeated_windows(docs, cells_bits=12), "doc_id", "n_words", "n_removed", "kept_sha256") == strings(want)


def test_windows_of_regular_words(spark):
    """Texts that agree under every polynomial modulo 2^64."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    same = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {other}"), (3, f"{same} {one}")], "doc_id long, text string")
    assert got(windows.repeated_windows(df), "doc_id", "n_removed") == strings([(1, 0), (2, 0), (3, 13)])
    assert got(suffix.repeated_bytes(spark.createDataFrame([(1, one), (2, one[:199] + other[:199])], "doc_id long, text string")), "doc_id", "n_removed") == brute(
        [(1, one), (2, one[:199] + other[:199])]
    )


def brute(rows):
    seen, want = {}, []
    for _, t in rows:
        for k in range(len(t) - 199):
            seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
    for i, t in rows:
        gone = set()
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        want.append((i, len(gone)))
    return strings(want)


@pytest.mark.parametrize("limits", [{}, {"hot": 2, "hottest": 4, "run": 40}])
def test_suffixes(monkeypatch, docs, rows, limits):
    monkeypatch.setattr(bundles, "BUNDLE_BYTES", 4000)
    texts, seen = [(t or "").encode() for _, t, _ in rows], {}
    for t in texts:
        for k in range(len(t) - 199):
            seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
    want = []
    for (i, *_), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((i, len(t), int(gone.sum()), spans, sha(bytes(np.frombuffer(t, np.uint8)[~gone]))))
    assert got(suffix.repeated_bytes(docs, **limits), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == strings(want)


def test_suffix_array_by_two_stages():
    rng = random.Random(4)
    for trial in range(150):
        data = bytes(rng.choice(b"ab\xff" if trial % 2 else b"abcdefgh") for _ in range(rng.randint(1, 300)))
        assert suffix.suffix_array(data, 400).tolist() == sorted(range(len(data)), key=lambda k: data[k:])


@pytest.mark.parametrize("hot", [False, True])
def test_exact(monkeypatch, docs, rows, hot):
    monkeypatch.setattr(exact, "HUGE", 2000)
    if hot:
        monkeypatch.setattr(exact, "GROUP_ROWS", 1)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = strings((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], sha((t or "").encode())) for i, t, _ in rows)
    assert got(exact.equal_text_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    left = exact.deduplicate(docs)
    assert left.count() == len(groups) and left.columns == docs.columns


def test_fingerprints_compose():
    data = bytes(random.Random(1).randbytes(5 * exact.CHUNK + 333))
    a, b = data[: 2 * exact.CHUNK], data[2 * exact.CHUNK :]
    assert exact.compose(exact.fingerprint(a), exact.fingerprint(b)) == exact.fingerprint(data)
    assert exact.fingerprint(data) != exact.fingerprint(data[:-1] + bytes([data[-1] ^ 1])) and exact.fingerprint(b"") == (0, 0, 0)


def test_empty_tables(docs, spark):
    none, no_vectors = docs.limit(0), spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        simhash.near_duplicates(none), tokens.count_tokens(none, tokenizer("word_bpe_49k.json")), lines.dedup_lines(none), ann.nearest(no_vectors, F.lit(True)),
        mixing.mix_report(none), mixing.mix(none, F.array("source")), bpe.digest(none, tokenizer("byte_bpe_50k.tiktoken")), toxicity.toxicity(none, labels),
        windows.repeated_windows(none), suffix.repeated_bytes(none), exact.equal_text_groups(none), exact.deduplicate(none),
    ):
        assert df.count() == 0
