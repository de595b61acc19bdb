"""Each operator against brute force or an exact round trip, with the edge cases of its docstring."""

import hashlib
import itertools
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tesserae.llm")
from tesserae.llm import bpe, decontaminate, graph, licences, neardup, packing, pii, quality, tokenstore, toxicity, urls, wordhash, wordpiece  # noqa: E402

DOCS = "doc_id long, text string"
WORDS = [a + b for a in "ba ce di fo gu ha je ki".split() for b in "lo mi nu pa re so".split()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame(list(enumerate(texts)), schema)


EDGES = [None, "", " ", "\n\n", "one", "a b c d e f g h i j", "x" * 50_000, "word " * 30_000, "a  b\t c　d", "é ö ß 日本語", prose(1, 300), prose(1, 300), "<|endoftext|> x"]


@pytest.fixture(scope="module")
def edges(spark):
    # names that clash with those the operators use inside
    return frame(spark, EDGES).withColumns({"digest": F.lit("d"), "rep": F.lit(1), "shard": F.lit("s"), "n_words": F.lit(-1), "kept": F.lit("k"), "score": F.lit("z"), "start": F.lit(0), "vector": F.lit(0), "a": F.lit(0), "b": F.lit(0)})


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_statistics_match_their_definition():
    texts = [*EDGES, "a b a b a b\nx y\nx y\n x y\n#$% a<b>", "  b\x1cc\x0bd", prose(3, 80) * 3]
    for t in texts:
        assert quality.statistics(t)[:5] == brute_statistics(t)


def test_quality_rules_are_learned_and_ordered(spark, edges):
    good = [prose(k, 120) for k in range(150)]
    bad = [prose(k, 120).replace(" ", " ### ") for k in range(200, 260)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge(docs, labels, keep=["doc_id"]).collect()}
    assert all(out[i].kept == (i < 150) for i in out)
    none = quality.judge(docs, labels.limit(0), keep=["doc_id"]).where("kept").count()
    assert none == 210
    got = quality.judge(edges, labels).collect()
    assert len(got) == len(EDGES) and [r.n_words for r in got] == [brute_statistics(t)[0] for t in EDGES]
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_quality_filter_keeps_columns_of_its_own_names(spark):
    docs = frame(spark, [prose(1, 80), "short", prose(2, 80)]).withColumns({"n_words": F.lit(-5), "rule": F.lit("mine"), "kept": F.lit("k"), "_in_rule": F.lit(1)})
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.accepted(docs, labels)
    assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {(-5, "mine", "k", 1)} and out.count() == 2


def test_decision_list_grows_conjunctions():
    r = np.random.default_rng(3)
    data = {f: r.random(3000) for f in quality.FEATURES}
    bad = (data["mean_word"] > 0.7) & (data["symbol_ratio"] <= 0.4)
    rules = quality.learn(data, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality.covered(rule, data, 3000)
    assert (hit == bad).mean() > 0.98 and any(len(x) > 1 for x in rules)
    assert quality.learn(data, np.zeros(3000, bool)) == []


def luhn(n):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(n))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    cards = [f"4{k:014d}" for k in range(40)]
    cards = [c + next(str(d) for d in range(10) if luhn(c + str(d))) for c in cards]
    texts = [f"pay {c} or {c[:4]} {c[4:8]} {c[8:12]} {c[12:]} on 2021-03-0{k % 9 + 1}, ask jo.{k}@mail.example.com" for k, c in enumerate(cards)]
    rows = pii.pseudonymised(frame(spark, texts), "k1").orderBy("doc_id").collect()
    seen = set()
    for c, t, r in zip(cards, texts, rows):
        m = re.fullmatch(r"pay (\d{16}) or (\d{4} \d{4} \d{4} \d{4}) on (\d{4}-\d\d-\d\d), ask ([a-z]{2}\.\d+)@mail\.example\.com", r.text)
        assert m and m[1] == m[2].replace(" ", "") and luhn(m[1]) and m[1] != c and r.n_items >= 3 and c not in r.text
        seen.add(m[1])
    assert len(seen) == len(cards)  # a permutation


def test_pseudonyms_leave_what_is_not_valid(spark):
    kept = [None, "", "nothing", "4111111111111112", "300.1.1.1", "2021-02-30", "version 1.2.3.4.5", "1234567", "000-12-1234", "x" * 60_000]
    out = [r.text for r in pii.pseudonymised(frame(spark, kept), "k1").orderBy("doc_id").collect()]
    assert out == kept
    assert pii.pseudonymised(frame(spark, kept).limit(0), "k1").count() == 0
    iban = pii.pseudonymised(frame(spark, ["GB82 WEST 1234 5698 7654 32 and 10.0.0.255"]), "k1").first().text
    m = re.fullmatch(r"(GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) and (\d+)\.(\d+)\.(\d+)\.(\d+)", iban)
    plain = m[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and all(int(x) < 256 for x in m.groups()[1:])
    assert m[1] != "GB82 WEST 1234 5698 7654 32"


def test_dates_are_permuted_within_their_format(spark):
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1950, 2020) for m in range(1, 13) for d in (1, 15, 28)]
    out = [r.text for r in pii.pseudonymised(frame(spark, days), "k1").orderBy("doc_id").collect()]
    assert len(set(out)) == len(days) and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", x) for x in out)
    slashed = pii.pseudonymised(frame(spark, [f"{d[8:]}/{d[5:7]}/{d[:4]}" for d in days]), "k1").orderBy("doc_id").collect()
    assert [f"{r.text[6:]}-{r.text[3:5]}-{r.text[:2]}" for r in slashed] == out


def brute_feistel(key, value, kind):
    """The network by its definition."""

    def shifted(half, other, number):
        out = ""
        for p, c in enumerate(half, 1):
            n = int(hashlib.sha256(f"{key}|{kind}|{number}|{p}|{other}".encode()).hexdigest()[:12], 16)
            low, size = (48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (ord(c), 1)
            out += chr(low + (ord(c) - low + n) % size)
        return out

    if len(value) == 1:
        return shifted(value, "", "alone")
    h = len(value) // 2
    for k in range(pii.ROUNDS):
        left, right = value[:h], value[h:]
        value = shifted(left, right, k) + right if k % 2 == 0 else left + shifted(right, left, k)
    return value


def test_pseudonyms_match_a_feistel_network_in_python(spark):
    r = random.Random(8)
    ssns = [f"{r.randrange(1, 900):03d}{r.randrange(1, 100):02d}{r.randrange(1, 10000):04d}" for _ in range(120)]
    ssns = [s for s in ssns if s[:3] != "666"]
    given = lambda s: not re.match("000|666|9", s) and s[3:5] != "00" and s[5:] != "0000"
    texts, want = [], []
    for k, s in enumerate(ssns):
        u = brute_feistel("k2", s, "ssn")
        while not given(u):
            u = brute_feistel("k2", u, "ssn")
        name, phone = r.choice(["x", "jo", "Mary.Ann7", "a-b_c"]), f"555-{r.randrange(1000):03d}-{r.randrange(10000):04d}"
        q = brute_feistel("k2", phone.replace("-", ""), "phone")
        texts.append(f"no {s[:3]}-{s[3:5]}-{s[5:]}, {name}@mail.example.com, call ({phone[:3]}) {phone[4:]} now")
        want.append(f"no {u[:3]}-{u[3:5]}-{u[5:]}, {brute_feistel('k2', name, 'mail')}@mail.example.com, call ({q[:3]}) {q[3:6]}-{q[6:]} now")
    rows = pii.pseudonymised(frame(spark, texts), "k2").orderBy("doc_id").collect()
    assert [x.text for x in rows] == want
    cut = lambda rows: [x.text[3:14] for x in rows]
    assert len(set(cut(rows))) == len(set(ssns)) and all(given(x.replace("-", "")) for x in cut(rows))
    assert [x.text for x in pii.pseudonymised(frame(spark, texts), "k3").orderBy("doc_id").collect()] != want


def test_pseudonyms_take_the_groups_that_are_valid(spark):
    card = "4111111111111111"
    texts = [card, card + " 123", "12 " + card, "7 4111 1111 1111 1111 99 code", "GB82 WEST 1234 5698 7654 32 EUR", card + "9", "x1@a.example"]
    out = [r.text for r in pii.pseudonymised(frame(spark, texts), "k1").orderBy("doc_id").collect()]
    new = out[0]
    grouped = " ".join(new[k : k + 4] for k in range(0, 16, 4))
    assert luhn(new) and new != card
    assert out[1:4] == [new + " 123", "12 " + new, f"7 {grouped} 99 code"]
    assert out[4] != texts[4] and out[4].endswith(" EUR") and out[5] == texts[5]


def test_pseudonyms_keep_columns_of_their_own_names(spark):
    docs = frame(spark, ["call 555-123-4567", None]).withColumns({"_items0": F.lit("i"), "_items": F.lit("j"), "_new0": F.lit(3), "_between": F.lit(4), "n_items": F.lit(-5), "`": F.lit(6)})
    out = pii.pseudonymised(docs, "k1")
    assert out.columns == docs.columns
    assert {tuple(r)[2:] for r in out.collect()} == {("i", "j", 3, 4, -5, 6)}


def brute_contamination(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    owners = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            owners[tuple(w[k : k + size])].add(str(i))
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(p) for p in owners}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in owners:
                    hit |= set(range(k, k + n))
                    found |= owners[p]
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_matches_brute_force(spark, edges, monkeypatch):
    items = [(k, prose(900 + k, 14)) for k in range(12)] + [(20, None), (21, ""), (22, "Short Item"), (23, prose(900, 14)), (23, prose(900, 14))]
    texts = [*EDGES, *[prose(k, 40) + " " + (items[k % 12][1] if k % 3 else "no") + ", " + prose(k + 50, 30) for k in range(30)], "short, ITEM! short item", items[0][1].upper()]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_contamination(list(enumerate(texts)), items))
    pick = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    assert sorted(tuple(r) for r in decontaminate.find(docs, bench).select(pick).collect()) == want
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 900)
    assert sorted(tuple(r) for r in decontaminate.find(docs, bench).select(pick).collect()) == want
    again = spark.createDataFrame([(1, items[0][1]), (1, items[1][1]), (1, items[0][1]), (None, items[2][1])], DOCS)
    assert [(r.doc_id, r.n_hit, r.items) for r in decontaminate.find(again, bench).orderBy("doc_id", "items").collect()] == [(None, 14, ["2"]), (1, 14, ["0", "23"]), (1, 14, ["0", "23"]), (1, 14, ["1"])]
    assert decontaminate.find(docs.limit(0), bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.clean(edges, bench).count() == sum(not x[2] for x in want[: len(EDGES)])


def test_proximity_matches(spark):
    def brute(w, phrases, slack):
        hit = set()
        for p in phrases:
            need, most = Counter(p), len(p) + slack
            for a in range(len(w)):
                e = next((e for e in range(a + 1, min(len(w), a + most) + 1) if not need - Counter(w[a:e])), None)
                if e and need - Counter(w[a + 1 : e]):
                    hit |= set(range(a, e))
        return len(hit)

    r = random.Random(4)
    texts = ["a x b y c", "c a b", "a z z z z z z b c", "a a b c a", "", None, *[" ".join(r.choice("abcdef") for _ in range(r.randrange(60))) for _ in range(60)]]
    items = ["a b c", "c c d e", "f"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.find(frame(spark, texts), bench, slack=2).collect()
    assert {x.doc_id: x.n_near for x in got} == {k: brute((t or "").split(), [i.split() for i in items], 2) for k, t in enumerate(texts)}
    first = {x.doc_id: x for x in got}
    assert first[0].near_items == ["0"] and first[0].items == [] and first[2].near_items == []
    assert all(set(x["items"]) <= set(x.near_items) for x in got)


def test_memo_holds_many_chunks_in_little_memory():
    # chunks of all lengths: hashed by words of eight bytes, or by running sums
    words = [b"%d" % (k * 7919) + b"x" * (k % 40) for k in range(300_000)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    key, check = wordhash.checked(np.frombuffer(b" ".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert len(np.unique(key)) == len(np.unique(check)) == len(words)
    moved = wordhash.checked(np.frombuffer(b" ".join([b"abc", *words[:200]]), np.uint8), ends[:200] - [len(w) for w in words[:200]] + 4, ends[:200] + 4)
    assert (moved[0] == key[:200]).all() and (moved[1] == check[:200]).all()
    memo = bpe.Memo(np.dtype("<u2"))
    for at in range(0, len(words), 50_000):
        assert (memo.find(key[at:], check[at:])[0] == -1).all()
        memo.add(key[at : at + 50_000], check[at : at + 50_000], [None if k % 5 == 4 else b"ab" * (k % 5) for k in range(at, min(at + 50_000, len(words)))])
    at, size = memo.find(key, check)
    assert len(memo) == len(words) and (at >= 0).all() and size.tolist() == [-1 if k % 5 == 4 else k % 5 for k in range(len(words))]
    assert sum(x.nbytes for x in vars(memo).values() if isinstance(x, np.ndarray)) < 45 * len(words)


def test_sketches_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(3)
    many = [np.zeros(0, "<u2"), *[rng.integers(0, 900, n).astype("<u2") for n in (1, 40, 700, 0, 2000)]]
    many.append(many[2].copy())
    weights, signs = rng.random(900).astype(np.float32), packing.directions(900)
    weights[7] = 0
    many.append(np.array([7, 7], "<u2"))
    found = packing.sketches(many, weights, packing.numbers(signs))
    assert np.allclose(found, [packing.sketch(x, weights, signs) for x in many], atol=1e-5)
    assert (found[2] == found[-2]).all() and (packing.sketches(many[2:3], weights, packing.numbers(signs)) == found[2]).all()
    assert packing.sketches([], weights, packing.numbers(signs)).shape == (0, packing.DIMS)


def test_packing_covers_every_token_once(spark, edges):
    docs = frame(spark, [*EDGES, *[prose(k % 7, 50 + 40 * k) for k in range(60)]])
    rows = packing.pack(docs).collect()
    encoder = bpe.encoder()
    ids = {r.doc_id: [*encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for i, x in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(x)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(edges).select("doc_id").distinct().count() == len(EDGES)


def test_packing_keeps_near_copies_in_one_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_CENTRES", 1)
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    docs = [prose(k // 2, 150) + (" nearly" if k % 2 else "") for k in range(300)]
    shard = {r.doc_id: r.sequence_id >> 32 for r in packing.pack(frame(spark, docs)).collect()}
    assert len(set(shard.values())) >= 15
    assert sum(shard[k] == shard[k + 1] for k in range(0, 300, 2)) >= 120
    # equal texts are spread, in shards of about SHARD_DOCS
    same = Counter(r.sequence_id >> 32 for r in packing.pack(frame(spark, [prose(1, 20)] * 200)).select("doc_id", "sequence_id").distinct().collect())
    assert len(same) == 10


@pytest.mark.parametrize("n", [4_000, 16_000])
def test_packing_recall_of_near_copies_does_not_fall_with_size(n, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 200)
    r = np.random.default_rng(n)
    base = r.normal(size=(n // 2, packing.DIMS))
    v = np.repeat(base / np.linalg.norm(base, axis=1, keepdims=True), 2, axis=0) + r.normal(size=(n, packing.DIMS)) * 0.005
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    shards = packing.Shards(v[:8].copy(), v[r.choice(n, packing.SHARD_SAMPLE * n // 200, replace=False)], n)
    own, _ = shards.place(v, list(range(n)))
    asked = np.arange(0, n, 100)
    near = v[asked] @ v.T
    near[np.arange(len(asked)), asked] = -1
    assert (own[asked] == own[near.argmax(axis=1)]).mean() >= 0.8


def test_packing_puts_neighbours_side_by_side_whatever_their_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    # pairs that have seven words in eight in common, among texts of the same vocabulary
    docs = [" ".join(w if k % 2 == 0 or j % 8 else prose(k * 1000 + j, 1) for j, w in enumerate(prose(k // 2, 120).split())) for k in range(600)]
    pieces = sorted(packing.pack(frame(spark, docs)).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = [k for k, _ in itertools.groupby(r.doc_id for r in pieces)]
    place = {d: k for k, d in enumerate(order)}
    assert len(order) == len(place) == 600
    assert sum(abs(place[k] - place[k + 1]) == 1 for k in range(0, 600, 2)) >= 240


def test_packing_graph_is_the_same_however_lists_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    sent, lists, _ = packing.tokens_of(frame(spark, [prose(k, 30) for k in range(150)]).select("doc_id", "text"), None, 1)
    index, graph, width = packing.graph_of(sent, lists)
    want = graph.orderBy("code").collect()
    assert len(want) == 150 and len({r.list for r in want}) > 4
    for tasks in (1, 3, 1000):
        dealt = packing.neighbour_graph(spark, index, width, tasks)
        got = dealt.orderBy("code").collect()
        assert dealt.rdd.getNumPartitions() <= tasks and [r[:4] for r in got] == [r[:4] for r in want]
        assert [set(r.near) for r in got] == [set(r.near) for r in want]
        assert np.allclose([r.sims for r in got], [r.sims for r in want], atol=1e-5)  # a product's last bits are those of its shape


def test_packing_graph_holds_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    docs = frame(spark, [*[prose(k, 40 + k % 90) for k in range(600)], *[prose(1, 41)] * 50, None, ""])
    assert packing.recall(docs, every=3) >= 0.9
    assert packing.recall(docs.limit(0)) == 1


def test_linked_leaves_no_edge_between_open_ends():
    r = np.random.default_rng(4)
    first = np.arange(0, 200, 2)
    last = np.where(r.random(100) < 0.5, first, first + 1)  # paths of one node and of several
    ends = np.union1d(first, last)
    a, b = r.choice(ends, 400), r.choice(ends, 400)
    a, b, sims = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], r.random(int((a != b).sum())).astype(np.float32)
    chains = packing.linked(first, last, a, b, sims)
    assert sorted(p for c in chains for p, _ in c) == list(range(100))
    chain, open_ = {}, Counter()
    edges = set(zip(a.tolist(), b.tolist(), strict=True))
    for k, c in enumerate(chains):
        sides = [(last[p], first[p]) if turned else (first[p], last[p]) for p, turned in c]
        for (_, x), (y, _) in itertools.pairwise(sides):
            assert (min(x, y), max(x, y)) in edges
        open_[sides[0][0]] += 1
        open_[sides[-1][1]] += 1
        chain |= {x: k for s in sides for x in s}
    assert len(chains) < 60
    assert all(chain[x] == chain[y] or not (open_[x] and open_[y]) for x, y in edges)


def test_linking_holds_few_bytes_for_a_path_and_no_edges():
    n, r = 20_000, np.random.default_rng(8)
    first = r.permutation(n) * 2
    last = np.where(r.random(n) < 0.3, first, first + 1)
    near = [(r.integers(0, n, 4_000), r.integers(-30, 30, 4_000)) for _ in range(25)]
    edges = [(first[i], last[np.clip(i + d, 0, n - 1)]) for i, d in near]
    tracemalloc.start()
    chains = packing.linked(first, last, iter(edges))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150 * n
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
    assert list(chains) == list(packing.linked(first, last, a, b, -np.arange(len(a), dtype=float)))
    # chains of chains: the paths of a turned one from its last to its first
    over = packing.Chains(np.array([2, 0, 1]), np.array([False, True, False]), np.array([0, 2, 3])).over(packing.Chains(np.arange(5, dtype=np.int32), np.array([False, True, False, False, True]), np.array([0, 2, 4, 5])))
    assert list(over) == [[(4, True), (1, False), (0, True)], [(2, False), (3, False)]]


def test_records_come_in_the_order_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "READ", 7)
    rows = spark.range(100).selectExpr("id * 37 % 101 as a", "-id as b").repartition(5)
    records = packing.Records(rows.orderBy(F.desc("a")), "some")
    a, b = records.columns()
    assert a.tolist() == sorted((k * 37 % 101 for k in range(100)), reverse=True) and all(-y * 37 % 101 == x for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert max(len(x) for x, _ in records.edges()) == 7
    assert packing.Records(rows.where("a < 0"), "none").columns()[0].tolist() == []
    back = packing.sent_back(spark, "back", "a long", 100, lambda x, y: {"a": a[x:y]})
    assert [r.a for r in back.orderBy(F.desc("a")).collect()] == a.tolist()
    assert packing.sent_back(spark, "back", "a long", 0, lambda x, y: {"a": a[x:y]}).count() == 0


def test_walk_visits_all_and_follows_neighbours():
    v = np.random.default_rng(2).normal(size=(300, packing.DIMS)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = packing.neighbours(v, 5)
    paths = packing.walk(g)
    assert sorted(itertools.chain(*paths)) == list(range(300))
    for p in paths:
        for a, b in zip(p, p[1:]):
            assert b in {j for _, j in g[a]}
    assert packing.walk(packing.neighbours(v[:1])) == [[0]]
    out = list(packing.fill([5000, 1, 3, 9000]))
    assert sum(x[2] for x in out) == 14004


def test_toxicity_finds_held_out_insults(spark, edges):
    r = random.Random(5)
    texts, marks = [], []
    for k in range(900):
        t = prose(k, 80).split()
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(["vile", "rotten", "nasty"]))
        texts.append(" ".join(t))
        marks.append(int(toxic))
    labels = spark.createDataFrame([(k, 1, m) for k, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    out = toxicity.score(frame(spark, texts), labels, keep=["doc_id"]).collect()
    held = [x for x in out if x.held_out]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out)
    right = sum(x.predicted == marks[x.doc_id] for x in held) / len(held)
    assert right > 0.95 and all(0 <= x.score <= 1 for x in out)
    scored = toxicity.score(edges, labels).collect()
    assert len(scored) == len(EDGES) and len({x.score for x in scored if not (x.text or "").strip()}) == 1
    assert toxicity.score(edges, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score(frame(spark, texts).limit(0), labels).count() == 0
    # labels of held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x.doc_id: x.score for x in toxicity.score(frame(spark, texts), flipped, keep=["doc_id"]).collect()}
    assert all(abs(again[x.doc_id] - x.score) < 1e-9 for x in out)


def brute_classes(texts):
    sets = []
    for t in texts:
        w = decontaminate.words(t)
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if (not s and not t) or s and t and len(s & t) / len(s | t) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in range(len(texts))}


def edited(text, seed, times):
    r, w = random.Random(seed), text.split()
    for _ in range(times):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
    return " ".join(w)


def test_toxicity_model_keeps_all_that_was_counted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE_TEXT", 2_000)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 300)
    docs = [f"only{k} once{k} {prose(k, 40)}" for k in range(80)]
    rows = [(t, int(k % 3 == 0), int(k % 4 == 1)) for k, t in enumerate(docs)]
    early, model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int, late int"), 8)
    for m, used in ((early, [r for r in rows if not r[2]]), (model, rows)):
        n, into, out = defaultdict(lambda: [0, 0]), defaultdict(set), defaultdict(lambda: [0, 0])
        for t, toxic, _ in used:
            w = t.split()
            for v, x in zip(["^", *w], w, strict=False):
                n[v, x][toxic] += 1
                into[x].add(v)
                out[v][toxic] += 1
        D, E, M = toxicity.DISCOUNT, toxicity.CONTINUATION, toxicity.BACKOFF_MASS
        words = [*into, None]  # None is the unknown word
        r = [{x: sum(1 for y in into[x] if n[y, x][b]) for x in into} for b in (0, 1)]
        K = toxicity.SHARED_SHARE * min(sum(x.values()) for x in r)
        every = sum(map(len, into.values()))
        shared = {x: (len(into.get(x, ())) + 0.5) / (every + 0.5 * len(words)) for x in words}
        u = [{x: (max(r[b].get(x, 0) - E, 0) + (sum(min(y, E) for y in r[b].values()) + K) * shared[x]) / (sum(r[b].values()) + K) for x in words} for b in (0, 1)]

        def p(b, v, x):
            lost = sum(min(z[b], D) for (y, _), z in n.items() if y == v)
            return (max(n.get((v, x), (0, 0))[b] - D, 0) + (lost + M) * u[b][x]) / (out.get(v, (0, 0))[b] + M)

        for v in ("^", "only1", "never", WORDS[0] + WORDS[1]):
            assert all(abs(sum(p(b, v, x) for x in words) - 1) < 1e-9 for b in (0, 1))

        def expected(v, x):
            return np.log(p(1, v, x) / p(0, v, x)) if x in into else 0.0

        texts = ["only0 once0", "only5 once5", "once7 only7 nowhere", "", docs[9]]
        got = m.features([toxicity.hashed(t) for t in texts])
        for t, g in zip(texts, got, strict=True):
            w = t.split()
            assert abs(g[0] - (np.mean([expected(*x) for x in zip(["^", *w], w, strict=False)]) if w else 0)) < 1e-5


def test_near_duplicates_match_brute_force(spark, edges, monkeypatch):
    base = [prose(k, 200) for k in range(12)]
    texts = [*EDGES, *base, *[edited(base[k % 12], k, k % 11) for k in range(150)]]
    want = brute_classes(texts)
    assert {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts)).collect()} == want
    monkeypatch.setattr(neardup, "PART", 4)  # every group is cut into parts
    monkeypatch.setattr(neardup, "PART_SHINGLES", 900)
    got = neardup.classes(frame(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(0.9 <= r.recall <= 1 for r in got)
    sizes = Counter(want.values())
    distinct = {k: len({" ".join(map(bytes.decode, decontaminate.words(texts[j]))) for j in want if want[j] == k}) for k in sizes}
    assert all((r.n_links > 0) == (distinct[r.class_id] > 1) for r in got)
    assert neardup.classes(frame(spark, texts).limit(0)).count() == 0
    left = neardup.deduplicated(edges)
    assert left.columns == edges.columns and left.count() == len(set(brute_classes(EDGES).values()))


def test_near_duplicates_of_few_shingles_are_found_at_any_distance(spark):
    docs = []
    for k in range(2_000):
        long = prose(k, 9)
        short = long.rsplit(" ", 1)[0]
        s, t = (neardup.shingles_of(x) for x in (short, long))
        code = [np.frombuffer(neardup.simhash(x), np.uint64) for x in (s, t)]
        if graph.distances(*code) > neardup.RADIUS and set(neardup.bands(s)) & set(neardup.bands(t)):
            assert neardup.jaccard(s, t) == 0.8
            docs += [short, long]
    assert docs
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, docs)).collect()}
    assert all(got[k] == got[k + 1] == k for k in range(0, len(docs), 2))


def test_audit_against_all_rows(spark):
    base = [prose(k, 90) for k in range(5)]
    texts = [edited(base[k % 5], k, k % 7) for k in range(60)] + ["", None]
    docs = frame(spark, texts)
    classes = neardup.classes(docs)
    rows = neardup.audit(docs, classes, 10).collect()
    sets = [set(neardup.shingles_of(t).tolist()) for t in texts]
    want = {(a, b) for a in range(0, 60, 10) for b in range(60) if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and {(r.doc_id, r.other) for r in rows} == want and all(r.found for r in rows)
    alone = docs.select("doc_id", F.col("doc_id").alias("class_id"))
    assert not any(r.found for r in neardup.audit(docs, alone, 10).collect())
    assert neardup.audit(docs.limit(0), classes).count() == 0


def test_the_audit_finds_what_the_graph_misses(spark, monkeypatch):
    base = [prose(k, 60) for k in range(6)]
    texts = [edited(base[k % 6], k, k % 9) for k in range(120)]
    want = brute_classes(texts)
    monkeypatch.setattr(neardup, "RADIUS", -1)  # nothing is in reach of the search, and few shingles are looked at in any distance
    got = neardup.classes(frame(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in got} == want and {r.recall for r in got} == {0.0}


def test_near_duplicates_take_rows_of_one_id_as_one_document(spark):
    a, b, c = prose(500, 120), prose(501, 120), prose(502, 120)
    rows = [(1, a), (1, b), (1, b), (2, edited(a, 1, 2)), (3, edited(b, 2, 2)), (4, c), (5, edited(c, 3, 2)), (5, b), (6, prose(503, 120)), (None, a)]
    got = sorted((r.doc_id, r.class_id) for r in neardup.classes(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6)]


def test_word_hashes_depend_on_words_only(monkeypatch):
    texts = [b"", b" ", b"a", b"  a b  ab ba a ", bytes(range(33, 127)), b"x" * 900 + b" y", b"q w " * 400, b"w" * 2000]
    words = {w for t in texts for w in t.split()}
    alone = {w: wordhash.hashes(w) for w in words}
    for chunk in (wordhash.CHUNK, 64):
        monkeypatch.setattr(wordhash, "CHUNK", chunk)
        wordhash.powers.cache_clear()
        for t in texts:
            got = wordhash.hashes(t)
            assert len(got) == len(t.split())
            assert all(g == alone[w][0] for g, w in zip(got, t.split(), strict=True) if len(w) <= chunk)
    wordhash.powers.cache_clear()
    assert len({int(x[0]) for x in alone.values()}) == len(words)


def test_sketches_leave_no_similar_pair_out():
    r = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 5000):
        for _ in range(200):
            common, own = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2), r.integers(0, 1 << 63, n, dtype=np.uint64)
            k = int(n * 0.25)  # at 0.8, or just above
            s, t = np.unique(np.concatenate([common, own[: k // 2]])), np.unique(np.concatenate([common, own[k // 2 : k]]))
            a, b = (np.frombuffer(neardup.sketch(x), np.uint8) for x in (s, t))
            assert neardup.jaccard(s, t) < 0.8 or neardup.likely(a, b[None], len(s), np.array([len(t)]))[0]
        far = [np.unique(np.concatenate([common[: n // 3], r.integers(0, 1 << 63, n, dtype=np.uint64)])) for _ in range(20)]
        assert n < 300 or not neardup.likely(a, np.array([np.frombuffer(neardup.sketch(x), np.uint8) for x in far]), len(s), np.array(list(map(len, far)))).any()


def test_long_chains_are_one_class(spark):
    w = prose(77, 200).split()
    texts = []
    for k in range(40):
        w[(k * 5) % 200] = f"step{k}"
        texts.append(" ".join(w))
    assert {r.class_id for r in neardup.classes(frame(spark, texts)).collect()} == set(brute_classes(texts).values())


def test_small_world_recall():
    r = np.random.default_rng(9)
    centres = r.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    codes = np.repeat(centres, 6, axis=0)
    for row in codes:
        for b in r.integers(0, 256, 20):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    shard = graph.Shard(codes, neardup.RADIUS)
    got = want = 0
    for c in codes[::7]:
        exact = {j for _, j in graph.exact(codes, c, neardup.RADIUS)}
        want += len(exact)
        got += len(exact & {j for _, j in shard.within(c)})
    assert got / want >= 0.9


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 300), (5, 5)]
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(1, 61)}, 200: 100, 300: 100}  # a root has no row of its own


def test_licences_survive_spelling_and_layout(spark, edges):
    mit = "Copyright (c) 2020 A. Author\n\n" + licences.MIT.upper().replace(" ", "  ").replace(",", " ,")
    texts = [mit, licences.MIT + " and more", "Text.\nThis work is LICENSED under the GNU General Public Licence, version 3!\nMore", None, "", "Released under the MIT License."]
    out = {(r.doc_id, r.unit, r.licence) for r in licences.scan(frame(spark, texts), licences.known(spark)).collect()}
    assert out == {(0, "text", "MIT"), (2, "line", "GPL-3.0"), (5, "text", "MIT")}
    odd = ["  \t(c) me\n\nCopyright: us\n* " + licences.ISC.replace("license", "licence"), "copyright 2020\nLicensed  under CC-BY 4.0", "x copyright\n" + licences.ZLIB, "=" * 3000 + licences.BSD_3 + licences.BSD_DISCLAIMER, "Sub-Licence & Non-Infringement"]
    extra = licences.known(spark).unionByName(spark.createDataFrame([("Own", "sublicense and noninfringement")], "licence string, text string"), allowMissingColumns=True)
    got = {(r.doc_id, r.unit, r.licence) for r in licences.scan(frame(spark, odd), extra).collect()}
    assert got == {(0, "text", "ISC"), (1, "text", "CC-BY-4.0"), (1, "line", "CC-BY-4.0"), (3, "text", "BSD-3-Clause"), (3, "line", "BSD-3-Clause"), (4, "text", "Own")} - {(3, "line", "BSD-3-Clause")}
    assert licences.scan(edges, licences.known(spark)).count() == 0
    assert licences.scan(edges, licences.known(spark).limit(0)).count() == 0


def test_long_licences_are_known_by_their_digests(spark):
    folder = Path("/usr/share/common-licenses")
    there = [n for n in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0") if (folder / n).exists()]
    texts = ["Copyright (C) 2021 us\n" + (folder / n).read_text().upper() for n in there]
    got = {r.doc_id: r.licence for r in licences.scan(frame(spark, texts or ["none"]), licences.known(spark)).where("unit = 'text'").collect()}
    assert got == {k: n if n[-2] == "." else n + ".0" for k, n in enumerate(there)}


def test_url_lists_are_joined_as_of(spark):
    entries = [("bad.com", "block", "2024-01-10"), ("bad.com", "allow", "2024-02-01"), ("ok.bad.com", "allow", "2024-01-15"), ("tie.com", "allow", "2024-01-01"), ("tie.com", "block", "2024-01-01"), (None, "block", "2024-01-01"), ("com", None, "2024-01-01")]
    rows = [("http://bad.com/x", "2024-01-09"), ("http://www.BAD.com:80/x", "2024-01-10"), ("https://u@ok.bad.com", "2024-01-20"), ("https://ok.bad.com", "2024-01-12"), ("http://bad.com", "2024-02-01"), ("http://tie.com.", "2024-03-01"), (None, "2024-01-01"), ("nothing", "2024-01-01"), ("http://bad.com", None), ("http://notbad.com", "2024-01-12"), ("http://bad.com/x", "2024-01-11"), ("http://bad.com/x", "2024-01-11")]
    caps = spark.createDataFrame([(k, u, d, "x") for k, (u, d) in enumerate(rows)], "page_id long, url string, fetched string, domain string").withColumn("fetched", F.to_date("fetched"))
    lists = spark.createDataFrame(entries, "domain string, action string, since string").withColumn("since", F.to_date("since"))
    out = [r.blocked for r in urls.judge(caps, lists).orderBy("page_id").collect()]
    assert out == [False, True, False, True, False, True, False, False, False, False, True, True]
    urls.BROADCAST_ENTRIES, kept = 0, urls.BROADCAST_ENTRIES
    try:
        assert [r.blocked for r in urls.judge(caps, lists).orderBy("page_id").collect()] == out
    finally:
        urls.BROADCAST_ENTRIES = kept
    assert urls.judge(caps.limit(0), lists).count() == 0
    assert not any(r.blocked for r in urls.judge(caps, lists.limit(0)).collect())


def test_token_files_round_trip(spark, edges, tmp_path):
    docs = frame(spark, [*EDGES, *[prose(k, 30 * k) for k in range(50)]])
    folder = f"file://{tmp_path}/tokens"
    files = tokenstore.write(docs, folder)
    rows = {r.doc_id: r for r in tokenstore.read(spark, folder, files).collect()}
    encoder, before = bpe.encoder(), 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        got = rows[r.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        assert (tokenstore.fetch(spark, folder, got.file, {r.doc_id})[r.doc_id] == ids).all()
        before += len(ids)
    # the tables are those of the public seekable format, and damage is noticed
    path = Path(tmp_path) / "tokens" / files[0][0]
    raw = path.read_bytes()
    assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
    path.write_bytes(raw[:30] + bytes([raw[30] ^ 255]) + raw[31:])
    with pytest.raises(Exception):
        tokenstore.read(spark, folder, files).collect()
    assert tokenstore.round_trip(docs.limit(0)).count() == 0
    assert tokenstore.round_trip(edges).count() == len(EDGES)


def test_token_files_keep_any_id(spark):
    rows = [(-(1 << 63), "least"), (None, "none"), (5, "five"), (5, "other five"), (None, "none either"), ((1 << 63) - 1, "most")]
    got = tokenstore.round_trip(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    want = Counter((i, zlib.crc32(np.array([*bpe.encoder().tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want


def test_packing_takes_rows_of_one_id_apart(spark):
    rows = [(1, prose(k, 30 + k)) for k in range(6)] + [(2, None), (2, ""), (None, prose(9, 40))]
    got = packing.pack(spark.createDataFrame(rows, DOCS)).collect()
    sizes = [len(bpe.encoder().tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    assert sum(r.length for r in got) == sum(sizes)
    whole = Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert whole == Counter((i, n) for (i, _), n in zip(rows, sizes, strict=True))


def test_toxicity_takes_the_highest_of_several_labels(spark):
    texts = [prose(k, 60) + (" vile rotten nasty" if k % 5 == 0 else "") for k in range(300)]
    one = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)], "doc_id long, toxic int")
    more = one.unionByName(spark.createDataFrame([(k, 0) for k in range(0, 300, 5)] + [(3, None), (None, 1), (7, 9)], "doc_id long, toxic int"))
    a, b = ({r.doc_id: r.score for r in toxicity.score(frame(spark, texts), x, keep=["doc_id"]).collect()} for x in (one, more))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_memo_encodes_as_the_library_does():
    small = bpe.Encoder(memo_limit=200)
    texts = [t or "" for t in EDGES] + [prose(k, 60) for k in range(40)] + ["a,b. c, d.. e.\nf g'll I'm 3, 4. x² ½, Ǆ. ́. a  b", "\x1c a", "tab\t b", "end "]
    r = random.Random(1)
    texts += ["".join(r.choice("ab Z\n .,'!?$1٣²½é́　\xa0\t_-日@") for _ in range(r.randrange(60))) for _ in range(3000)] + ["ab " * 90_000 + "ab", "y" * 300_000 + " y"]
    for _ in range(2):
        assert small.encode(texts) == small._plain(texts)
    assert len(small.memo) <= 6000 and small.encode([]) == [] and small.encode([""]) == [b""]


def test_memo_learns_a_word_once_whatever_stands_beside_it():
    r = random.Random(2)
    words = sorted({"".join(r.choices("abcdeéßŀ", k=9)) for _ in range(500)})
    texts = [f"{w}, {w}.\n{w} ({w}) {w}!! {w}1 {w}\n{w}; {w}×{w}" for w in words]
    encoder = bpe.Encoder()
    assert encoder.encode(texts) == encoder._plain(texts)
    # with a space, without one, and beside a byte of no known kind
    assert len(encoder.memo) <= 3 * len(words) + 20


def test_parts_end_where_two_known_kinds_meet():
    for text, want in (
        ("ab,c1 é.\nÉ", "ab|,|c|1|é|.|\n|É"),
        ("it's ab\n\nc x×y 'q\n", "it's|ab\n\nc|x×y|'q\n"),
        ("\na \n", "\na|\n"),
        ("日a. 1st--2", "日a|.|1|st|--|2"),
        ("", ""),
        ("  ", ""),
    ):
        raw = text.encode()
        _, begins, ends = wordhash.parts(raw)
        assert "|".join(raw[b:e].decode() for b, e in zip(begins, ends, strict=True)) == want


def test_automaton_counts_like_greedy_matching(spark, edges):
    r = random.Random(4)
    first, later = ({bytes(r.choices(b"abc", k=r.randrange(1, 5))) for _ in range(25)} for _ in range(2))
    later |= {b"a", b"b"}
    machine = wordpiece.Automaton(first, later)
    for _ in range(3000):
        w = bytes(r.choices(b"abcd" if r.random() < 0.2 else b"abc", k=r.randrange(1, 14)))
        assert machine.word(w) == wordpiece.greedy(w, first, later), w
    first, later = wordpiece.vocabulary()
    out = {r.doc_id: r.n_tokens for r in wordpiece.count_tokens(edges, keep=["doc_id"]).collect()}
    for k, t in enumerate(EDGES):
        assert out[k] == sum(wordpiece.greedy(w, first, later) for w in (t or "").encode().split())
    assert wordpiece.count_tokens(edges.limit(0)).count() == 0
