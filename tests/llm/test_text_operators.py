"""Corpus operators against brute force on small inputs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import byte_bpe, jaccard_join, license_scan, packing, quality_rules, textkit, toxicity
from quarry.llm.line_dedup import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall(text or "")


# --- words and shingles ---------------------------------------------------------------------


def test_word_spans_are_the_words(odd_docs):
    texts = [r.text for r in odd_docs.collect()]
    raw, bounds = textkit.string_buffers(pa.array(texts))
    starts, ends, first = textkit.word_spans(raw, bounds)
    for i, t in enumerate(texts):
        assert [bytes(raw[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == words_of(t)


def test_word_hashes_don_t_depend_on_spans(monkeypatch):
    raw, bounds = textkit.string_buffers(pa.array(["a bb ccc " * 50, "dddd " * 9]))
    starts, ends, _ = textkit.word_spans(raw, bounds)
    whole = textkit.word_hashes(raw, starts, ends, True)
    monkeypatch.setattr(textkit, "SPAN", 7)
    assert (textkit.word_hashes(raw, starts, ends, True) == whole).all()


def shingles(text):
    w = words_of((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """id -> (set size, smallest linked id), by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.fixture(scope="module")
def near_copies():
    """Chains of edits, exact copies, shared passages, tiny texts, and pairs at exactly the threshold."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([5, 6, 9, 30, 120, 400]))
        if rng.random() < 0.4:
            base += passage
        rows.append(" ".join(base))
        own = base
        for _ in range(rng.randint(0, 6)):
            own = list(own)
            for _ in range(rng.choice([0, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own).upper() if rng.random() < 0.3 else " ".join(own))
    rows += ["p q r s t u v w", "p q r s t u v w x", "p q r s t u v w x y", "a b", "A B", "a b c", "", "  "]
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


def test_jaccard_components(spark, near_copies):
    docs = spark.createDataFrame(near_copies, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == components(near_copies)


def test_jaccard_with_trees_alone_and_small_blocks(spark, near_copies, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    docs = spark.createDataFrame(near_copies, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == components(near_copies)


def test_signature_tree_keeps_every_link():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 60, int(rng.integers(5, 300)), dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: int(len(base) * 0.95)], rng.integers(0, 1 << 60, 3, dtype=np.uint64)]))]
    maps = np.stack([np.frombuffer(jaccard_join._bitmap(s), np.uint64) for s in sets])
    x, y = jaccard_join.SignatureTree(np.array([len(s) for s in sets]), maps, np.arange(len(sets))).pairs()
    found = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    links = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links.add((a, b))
    assert links and links <= found and len(found) < 4 * len(links)


def test_neighbour_keys_cover_links_at_their_worst():
    """One set lacks every second of the other's first hashes, as many as a link allows."""
    for n in range(5, 600):
        whole = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(1 << 40)
        for left_out in {n // 5, max(0, n // 5 - 1)}:
            for first in (0, 1):
                part = np.delete(whole, np.arange(first, first + 2 * left_out, 2)[:left_out])
                if len(part) < n and 100 * len(part) >= 80 * n:
                    assert set(jaccard_join.neighbour_keys(whole).tolist()) & set(jaccard_join.neighbour_keys(part).tolist())


def test_jaccard_links_are_all_pairs(spark, near_copies):
    docs = spark.createDataFrame(near_copies, "doc_id long, text string")
    sets = {}
    for i, t in near_copies:
        if shingles(t):
            sets.setdefault(shingles(t), []).append(i)
    want = {(min(p), min(q)): (len(p), len(q)) for a, p in sets.items() for b, q in sets.items() if a != b and 100 * len(a & b) >= 80 * len(a | b)}
    rows = jaccard_join.jaccard_links(docs).collect()
    assert len(rows) * 2 == len(want) > 0
    assert all(want[r.a, r.b] == (r.copies_a, r.copies_b) for r in rows)
    counts = {r.doc_id: r.n_links for r in jaccard_join.link_counts(docs).collect()}
    for p in sets.values():
        n = sum(want[min(p), j][1] for i, j in want if i == min(p))
        assert counts.get(min(p), 0) == (n + len(p) - 1 if n else 0)


def test_jaccard_with_a_passage_that_many_share(spark, monkeypatch):
    """Groups beyond a block are posted anew under rare shingles; links within them stay."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=120)
    rows = []
    for i in range(150):
        own = rng.choices(vocabulary, k=60)
        rows.append(" ".join(passage + own))
        if i % 5 == 0:
            rows.append(" ".join([*passage, *own[:-3], "x", "y", "z"]))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == components(rows)


def test_neighbour_keys_cover_random_links():
    rng = random.Random(2)
    for _ in range(3000):
        union = sorted(rng.sample(range(1 << 40), rng.randint(5, 400)))
        apart = rng.sample(union, len(union) // 5)
        a = [x for x in union if x not in apart[::2]]
        b = [x for x in union if x not in apart[1::2]]
        if 100 * len(set(a) & set(b)) >= 80 * len(union) and a != b:
            ka, kb = (set(jaccard_join.neighbour_keys(np.array(s, np.uint64)).tolist()) for s in (a, b))
            assert ka & kb


def test_jaccard_odd_and_empty(spark, odd_docs):
    rows = jaccard_join.jaccard_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    assert jaccard_join.jaccard_components(odd_docs.limit(0)).count() == 0


# --- byte-level BPE -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_is_tiktoken_s(codec):
    import public_tokenizers
    import tiktoken

    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    signs = "ab  \n\t\r\x1c\x85\xa0 éß中文😀0١²'srtld.,-_<|>ththeing"
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        ids = codec.encode(text)
        assert ids == whole.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_memos_start_anew(codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "MEMO_PAIRS", 3)
    own = byte_bpe.ByteBPE(codec.ranks, r"\S+|\s+")
    text = "unbelievable antidisestablishmentarianism qwertyuiop zxcvbnm"
    assert own.encode(text) == [i for p in re.findall(r"\S+|\s+", text) for i in byte_bpe.merge_by_rank(p.encode(), codec.ranks)]
    assert len(own.pieces) <= 4


def test_bpe_round_trip_table(spark, odd_docs, codec):
    import public_tokenizers

    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    for r in byte_bpe.round_trip_digests(odd_docs, *args).join(odd_docs, "doc_id").where("doc_id = 4").collect():
        assert r.n_tokens > 0
    back = byte_bpe.decode(byte_bpe.encode(odd_docs, *args), *args)
    assert all(bytes(r.decoded) == (r.doc.doc.text or "").encode() for r in back.collect())
    assert {(r.doc_id, r.decoded_sha256) for r in byte_bpe.round_trip_digests(odd_docs, *args).collect()} == {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd_docs.collect()}
    assert byte_bpe.round_trip_digests(odd_docs.limit(0), *args).count() == 0


# --- packing --------------------------------------------------------------------------------


def test_first_fit_decreasing_is_plain_first_fit():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 2048) for _ in range(rng.randint(1, 80))]
        bins, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            b = next((k for k, used in enumerate(bins) if used + lengths[i] <= 2048), len(bins))
            if b == len(bins):
                bins.append(0)
            want[i] = (b, bins[b])
            bins[b] += lengths[i]
        assert packing.first_fit_decreasing(lengths) == [want[i] for i in range(len(lengths))]


def test_packing_ids_of_plain_texts_are_those_of_tokenizers():
    """Every pair of code points below U+0250, next to letters, digits and white space."""
    import public_tokenizers
    from tokenizers import Tokenizer

    paths = [public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken")]
    slow = Tokenizer.from_file(paths[0])
    points = [chr(c) for c in range(0x250)]
    texts = ["".join(f"a{c}{d}b {c}{d}1 \n{c}{d} " for d in points) for c in points]
    assert all(packing._PLAIN.fullmatch(t) for t in texts)
    for text, want in zip(texts, slow.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing.token_ids(text, *paths, public_tokenizers.PATTERN)[:-1].tolist() == want.ids


def test_packing_places_every_id_once(spark, odd_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    args = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = odd_docs.unionByName(spark.createDataFrame([(99, "a <|endoftext|> b")], "doc_id long, text string"), allowMissingColumns=True)
    rows = packing.pack(docs, *args, group_size=4, with_ids=True).collect()
    slow = Tokenizer.from_file(args[0])
    want = Counter()
    for d in docs.collect():
        want.update((d.doc_id, i) for i in [*slow.encode(d.text or "", add_special_tokens=False).ids, 1])
    assert Counter((r.doc_id, i) for r in rows for i in r.ids) == want
    by = {}
    for r in rows:
        assert r.length == len(r.ids)
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p.length for p in pieces) <= packing.CAPACITY
    assert packing.pack(docs.limit(0), *args).count() == 0


# --- toxicity -------------------------------------------------------------------------------


def toxic_texts(n, seed):
    rng = random.Random(seed)
    calm = [f"{a}{b}" for a in "ba ce di fo gu".split() for b in "lan mer tin sol".split()]
    bad = ["vileword", "crudeword", "meanword"]
    texts, labels = [], []
    for _ in range(n):
        label = rng.random() < 0.3
        words = [rng.choice(bad) if label and rng.random() < 0.06 else rng.choice(calm) for _ in range(rng.randint(30, 300))]
        if label and not set(words) & set(bad):
            words[0] = bad[0]
        texts.append(" ".join(words))
        labels.append(int(label))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def net():
    return toxicity.train(*toxic_texts(300, 1), steps=150)


def test_toxicity_learns(net):
    texts, labels = toxic_texts(200, 2)
    predicted = net.score(pa.array(texts)) >= 0.7
    assert (predicted == labels).mean() > 0.95


def plain_score(net, text):
    """A text's score word by word, window by window, step by step."""
    data, starts, ends, first = toxicity._tokens(*textkit.string_buffers(pa.array([text], pa.large_string())))
    words = []
    for a, b in zip(starts, ends):
        hashes = textkit.word_hashes(data, np.array([a]), np.array([b]), lower=False)
        own, grams = toxicity._gram_lists(data, np.array([a]), np.array([b]))
        chars = sum((net.params["gram"][g] for g in grams), np.zeros(toxicity.CHAR_DIM)) / max(1.0, np.sqrt(len(grams)))
        words.append(np.concatenate([net.params["word"][net.word_ids(hashes)[0]], chars]))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    H, logits, at = toxicity.HIDDEN, [], 0
    while True:
        window, states = words[at : at + toxicity.WINDOW], {}
        for way in "fb":
            h = np.zeros(H)
            for t in range(len(window)) if way == "f" else reversed(range(len(window))):
                x, g = net.params[f"x{way}"] @ window[t] + net.params[f"b{way}"], net.params[f"u{way}"] @ h
                z, r = sigmoid(x[:H] + g[:H]), sigmoid(x[H : 2 * H] + g[H : 2 * H])
                h = z * h + (1 - z) * np.tanh(x[2 * H :] + r * g[2 * H :])
                states[way, t] = h
        pooled = np.zeros(2 * H)
        if window:
            both = np.stack([np.concatenate([states["f", t], states["b", t]]) for t in range(len(window))])
            e = np.exp(both @ net.params["attend"] - (both @ net.params["attend"]).max())
            pooled = (e / e.sum()) @ both
        logits.append(net.params["out"] @ pooled + net.params["bias"][0])
        if at + toxicity.WINDOW >= len(words):
            break
        at += toxicity.STRIDE
    prob, n = [sigmoid(x) for x in logits], len(logits)
    features = [1, max(logits), np.log1p(sum(prob)), sum(prob) / n, sum(p > 0.5 for p in prob) / n, np.log(n)]
    return sigmoid(np.dot(features, net.text_weights) + net.offset)


def test_toxicity_scores_are_those_of_plain_steps(net):
    texts = [*toxic_texts(12, 7)[0], "", "   ", "one", "wörd " * 90, "a b c " * 40 + "Élan"]
    assert np.allclose(net.score(pa.array(texts)), [plain_score(net, t) for t in texts], atol=2e-4)


def test_toxicity_held_out_accuracy(tables):
    """Trained on the rows that may be learned from, scored on the others, of the smallest tables that have enough."""
    import zlib

    import pyarrow.parquet as pq

    folder = tables.replace("sf0.001", "sf0.1")
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    rows = [(r["doc_id"], r["toxic"]) for r in pq.read_table(f"{folder}/labels.parquet").to_pylist() if r["doc_id"] in docs]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    own, other = [r for r in rows if not held(r[0])], [r for r in rows if held(r[0])]
    net = toxicity.train([docs[i] for i, _ in own], np.array([y for _, y in own]), steps=300)
    score, label = net.score(pa.array([docs[i] for i, _ in other])), np.array([y for _, y in other])
    better = (score[label == 1][:, None] > score[label == 0][None, :]).mean()
    assert better > 0.95 and (score[label == 1] >= 0.7).mean() > 0.8 and (score[label == 0] >= 0.7).mean() < 0.05


def test_toxicity_gradients():
    net = toxicity.Network.fresh(np.zeros(0, np.uint64), 1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(0)
    x, words = rng.standard_normal((6, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32), rng.integers(0, 6, (5, 4))
    mask = np.ones((5, 4), np.float32)
    mask[3:, 1] = 0
    label = np.array([1, 0, 1, 0], np.float32)

    def loss():
        logit = net.pooled(net.states(net.project(x), words, mask), mask)[2]
        return float(np.mean(np.logaddexp(0, logit) - label * logit))

    grad, dx = net.gradients(x, words, mask, label)
    for name, at in (("xf", (1, 2)), ("ub", (25, 3)), ("attend", (4,)), ("out", (7,)), ("bb", (12,)), ("uf", (3, 3))):
        keep = net.params[name][at]
        net.params[name][at] = keep + 1e-3
        up = loss()
        net.params[name][at] = keep - 1e-3
        down = loss()
        net.params[name][at] = keep
        assert abs((up - down) / 2e-3 - grad[name][at]) < 2e-3, name


def test_toxicity_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        begin, end, firsts = toxicity._window_index(np.array([0, n]))
        seen = {k for a, b in zip(begin, end) for k in range(a, b)}
        assert seen == set(range(n)) and firsts[-1] >= 1
        assert all(b2 < e1 for e1, b2 in zip(end, begin[1:]))


def test_toxicity_table(spark, odd_docs, net):
    rows = toxicity.score_toxicity(odd_docs, net).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r.doc.text, r.score) == r.score
    none = odd_docs.sparkSession.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.fit_toxicity(odd_docs, none).constant == 0.0
    assert toxicity.score_toxicity(odd_docs.limit(0), net).count() == 0


def test_held_out_labels_are_not_read(spark):
    import zlib

    texts, labels = toxic_texts(40, 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {r.doc_id for r in docs.where(toxicity.held_out(docs.doc_id)).collect()} == set(held)
    table = lambda flip: spark.createDataFrame([(i, int(v) ^ (flip and i in held)) for i, v in enumerate(labels)], "doc_id long, toxic int")
    a, b = (toxicity.fit_toxicity(docs, table(flip), steps=5) for flip in (False, True))
    assert all((a.params[k] == b.params[k]).all() for k in a.params)


# --- quality rules --------------------------------------------------------------------------


def plain_counts(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(set(w))


def test_quality_counts(odd_docs):
    rng = random.Random(4)
    texts = [r.text for r in odd_docs.collect()] + ["".join(rng.choice("ab é#|\n\t ") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    c = quality_rules.text_counts(pa.array(texts))
    got = list(zip(c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], c["n_distinct_words"]))
    assert got == [plain_counts(t) for t in texts]


def test_decision_list_learns_conjunctions():
    rng = np.random.default_rng(0)
    values = {"symbols_per_word": rng.random(3000), "upper_per_char": rng.random(3000)}
    bad = ((values["symbols_per_word"] > 0.7) & (values["upper_per_char"] > 0.5)) | (values["upper_per_char"] < 0.1)
    rules = quality_rules.learn_decision_list(values, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality_rules._holds(r, values, 3000)
    assert (hit == bad).mean() > 0.97 and all(len(r) <= 4 for r in rules)


def test_quality_table(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_rules.quality_filter(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        n, *_, repeat, _ = plain_counts(r.doc.text)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and r.kept == (not r.base_failed)
    rule = (quality_rules.Condition("words", True, 10.0),)
    text = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)))], "doc_id long, text string")
    assert not quality_rules.quality_filter(text, labels, rules=[rule]).first().kept
    assert quality_rules.quality_filter(odd_docs.limit(0), labels).count() == 0


# --- line dedup -----------------------------------------------------------------------------


def test_line_dedup(spark, odd_docs):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice(["Common", " common\t", "rare %d" % rng.randint(0, 40), "", "é", "É"]) for _ in range(rng.randint(0, 8))) for _ in range(120)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(i % 50, t) for i, t in enumerate(texts)]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    spread = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if spread[key(x)] < 10 or not key(x)]
        want[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        assert Counter((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup(docs, least_batches=batches, fanout=fanout).collect()) == want
    assert line_dedup(docs.limit(0)).count() == 0


# --- licences -------------------------------------------------------------------------------


def test_license_scan(spark, odd_docs):
    model = license_scan.train()
    filler = "Erated of the thand tion erly onend re stedat. " * 12
    cases = [(filler + "\nReleased under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0. " + filler, "Apache-2.0"), (filler, None), ("The licence to fish was released under the bridge.", None), (None, None), ("", None)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc.doc_id: r.license_family for r in license_scan.license_scan(docs, model=model).collect()}
    assert got == {i: f for i, (_, f) in enumerate(cases)}
    assert license_scan.license_scan(odd_docs, model=model).count() == odd_docs.count()


def test_wrapped_license_notices():
    model = license_scan.train()
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mit = "Permission is hereby granted, free of\ncharge, to any person obtaining a\ncopy of this software and associated documentation files"
    filler = "Erated of the thand tion erly onend re stedat.\n" * 3
    texts = [gpl, "# " + gpl.replace("\n", "\n# "), filler + mit + "\n" + filler, gpl + "\n \t\n" + mit, mit.replace("\n", "\n \r\n"), gpl[:40], gpl[40:90]]
    found = [sorted(f) for f in license_scan.scan_texts(model, pa.array(texts))]
    assert found == [["GPL"], ["GPL"], ["MIT"], ["GPL", "MIT"], [], [], []]


def test_license_families_are_found_in_other_words():
    """Every notice of every family, set into prose that no training saw; near misses and prose name none."""
    model = license_scan.train()
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice("river stone walks under bright morning window they carry seven letters home and nobody asks".split()) for _ in range(n))
    cases = [(f, t) for f, notices in license_scan.TEMPLATES.items() for t in notices]
    texts = [f"{prose(30)}\n\n{prose(rng.randint(0, 9))} {t}. {prose(9)}\n\n{prose(30)}" for _, t in cases]
    found = license_scan.scan_texts(model, pa.array(texts))
    right = [f in g for (f, _), g in zip(cases, found)]
    assert sum(right) >= 0.95 * len(cases)
    assert sum(len(set(g) - {f}) for (f, _), g in zip(cases, found)) <= 0.05 * len(cases)
    assert not any(license_scan.scan_texts(model, pa.array([prose(60) for _ in range(200)] + ["the terms of the agreement were granted to any person in the public domain of rights"])))


def test_license_shares_are_those_of_plain_comparison():
    """The confirming share by brute force over the words of short texts."""
    model = license_scan.train()
    grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 3 else {tuple(w[k : k + 2]) for k in range(len(w) - 1)}
    split = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    for family, notices in license_scan.TEMPLATES.items():
        text = "we say: " + " ".join(notices[0].split()[:40])
        for found in license_scan.scan_texts(model, pa.array([text])):
            if family in found:
                w = split(text)
                seen = {tuple(w[k : k + n]) for n in (2, 3) for k in range(len(w) - n + 1)}
                assert found[family][1] == max(sum(g in seen for g in grams(split(t))) / len(grams(split(t))) for t in notices)


def test_line_runs_merge_without_shuffles(spark):
    """Only a new batch is shuffled; runs meet bucket by bucket, and the counts are right."""
    from pyspark.sql import functions as F

    from quarry.llm.line_dedup import LevelledRuns

    rng = random.Random(4)
    runs, total = LevelledRuns(spark, threshold=12, fanout=2, buckets=4), Counter()
    for _ in range(5):
        counts = Counter(rng.choices([bytes([k]) * 16 for k in range(40)], [1 + k for k in range(40)], k=60))
        total.update(counts)
        batch = spark.createDataFrame([(k, n) for k, n in counts.items()], "key binary, n long")
        if runs.settled is not None:
            plan = batch.repartition(4, "key").join(runs.settled.hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1
        runs.add(batch)
    two = runs.tables[-1], runs.tables[0]
    plan = runs._merged([spark.table(t) for t in two if "n" in spark.table(t).columns] or [runs.levels[0][0]])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {bytes(r.key) for r in runs.frequent().collect()} == {k for k, n in total.items() if n >= 12}
    assert runs.frequent().select(F.count("*") - F.count_distinct("key")).first()[0] == 0
    runs.drop()
