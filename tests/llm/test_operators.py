"""Operators against brute force on small tables, with nulls, empty, long and repeated rows."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import chat, components, decontaminate, jaccard, langid, lm, mixing, simhash, sketch, suffixes, toxicity, urls
from packetloom.llm import _bytes as B
from packetloom.llm._shared import written

rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, k string, t string"


@pytest.fixture(scope="module")
def rows():
    base = [prose(rng.randint(1, 60)) for _ in range(40)]
    passage = prose(40)
    texts = [*base, base[3], base[3] + " tail", passage + " " + base[4], base[5] + " " + passage, base[6][:30] + "é" + base[6], None, "", " \n", "!", prose(9000), "é" * 70, "x" + "é" * 70]
    return [(i * 3, t, None, None, None, 0.5, "k", "t") for i, t in enumerate(texts)] + [(9, base[3], None, None, None, 0.5, "k", "t"), (None, base[3], None, None, None, 0.5, "k", "t")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- SimHash ---------------------------------------------------------------------------------
def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, ids):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for k, i in zip(label, ids, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return [least.get(k) for k in label]


@pytest.mark.parametrize("bucket", [4096, 4])
def test_simhash(docs, rows, bucket):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, bucket=bucket).collect())
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = sorted((r[0] if r[0] is not None else -1, f"{fp:016x}", c) for r, fp, c in zip(rows, fps, classes(fps, [r[0] for r in rows]), strict=True))
    assert got == want


@pytest.mark.parametrize("bucket", [4096, 8])
def test_simhash_links_of_near_fingerprints(spark, bucket):
    r = np.random.default_rng(1)
    center = [int(x) for x in r.integers(0, 1 << 63, 6)]
    fps = sorted({c ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 9)), replace=False)) for c in center for _ in range(40)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    found = {x.node: x.root for x in components.components(simhash.links(df, bucket=bucket)).collect()}
    want = classes(fps, list(range(len(fps))))
    mine = [found.get(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(len(fps)))


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}


@pytest.mark.parametrize("few", [None, 0])
def test_components_of_few_links_take_no_rounds(spark, monkeypatch, few):
    r = random.Random(3)
    pairs = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)] + [(5, None), (9, 9)]
    tables, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, label: tables.append(label) or write(df, label))
    got = {x.node: x.root for x in components.components(spark.createDataFrame(pairs, "u bigint, v bigint"), few=few).collect()}
    label = {x: x for u, v in pairs if v is not None and u != v for x in (u, v)}
    for _ in label:
        for u, v in pairs:
            if v is not None and u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label
    assert len(tables) == 1 if few is None else len(tables) > 2


# --- similar texts ---------------------------------------------------------------------------
def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_roots(texts):
    sets, label = [slow_shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def edited():
    r = random.Random(12)
    texts = [prose(r.randint(1, 300), r) for _ in range(60)] + [None, "", " \n", "one two", "ONE  two", "one two three"]
    for k in range(60):
        words = texts[k].split()
        for at in r.sample(range(len(words)), min(len(words), len(words) * r.randint(1, 9) // 200)):
            words[at] = "edit"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("bucket", [2048, 2])
def test_similar_texts(spark, bucket):
    texts = edited()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marked = written(jaccard.marked(rows), "marked")
    roots = {r.set_id: r.root for r in jaccard.classes(marked, bucket=bucket).collect()}
    ids = {r.doc_id: r.set_id for r in marked.select("doc_id", "set_id").collect()}
    mine, want = [roots.get(ids[i], ids[i]) for i in range(len(texts))], slow_roots(texts)
    assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))


def test_a_full_bucket_is_compared_in_little_memory():
    r = random.Random(1)
    own = ["".join(r.choices("abcdefghij", k=9)) for _ in range(5000)]
    texts = pa.chunked_array([[" ".join(r.choices(own, k=512)) for _ in range(jaccard.BUCKET // 2)] for _ in range(2)] + [[None, "", "one two"]])
    tracemalloc.start()
    try:
        sets, bounds = jaccard.sets_of(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 200e6  # by shingles() at once 623 MB
    data, offsets = B.column_bytes(texts)
    want = jaccard.shingles(data[offsets[2040] :], offsets[2040:] - offsets[2040])
    assert len(bounds) == len(texts) + 1 and np.array_equal(sets[bounds[2040] :], want[0]) and np.array_equal(bounds[2040:] - bounds[2040], want[1])


def test_pipeline_drops_edited_copies(spark):
    texts = edited()
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(None, texts[0], "en", "a", 1)] * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    want = slow_roots(texts)
    assert sorted(k for k in kept if k is not None) == [i for i in range(len(texts)) if want[i] == i] and kept.count(None) == 2


def test_pipeline_drops_what_only_simhash_finds(spark, monkeypatch):
    """A cycle decides the fingerprint; without MinHash keys, what SimHash links is compared and the exact similarity decides."""
    marked, r = jaccard.marked, random.Random(5)
    monkeypatch.setattr(jaccard, "marked", lambda df: marked(df).withColumn("keys", F.expr("cast(array() as array<bigint>)")))
    head, tails = "alpha beta gamma " * 200, [" ".join(f"w{r.randrange(10**9)}" for _ in range(30)) for _ in range(2)]
    texts = [head + tails[0], head + tails[0] + " more", head + tails[1], prose(40, r)]
    assert len({simhash.fingerprint(t.encode()) for t in texts[:3]}) == 1
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 3]


def test_pipeline_keeps_other_texts_of_a_repeated_id(spark):
    a, b, c = (prose(40, random.Random(k)) for k in (1, 2, 3))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in [(5, a), (5, b), (5, b), (2, b), (7, a), (7, c)]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted([(5, a), (2, b), (7, c)])


# --- suffixes --------------------------------------------------------------------------------
def slow_repeats(rows):
    raw = [(k, (t or "").encode()) for k, t in rows]
    first = {}
    for k, b in raw:
        if k is not None:
            for i in range(len(b) - 49):
                first[b[i : i + 50]] = min(first.get(b[i : i + 50], k), k)
    out = []
    for k, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if k is not None and first[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        out.append((-1 if k is None else k, len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_removal(docs, rows, hot):
    got = suffixes.remove_repeats(docs, carry=("t",), block_rows=9, hot_spans=hot).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(e - s for s, e in zip(r.starts, r.ends)), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == slow_repeats([r[:2] for r in rows])
    assert {r.t for r in got} == {"t"}


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_suffix_order(block):
    r = np.random.default_rng(4)
    data = np.concatenate([r.integers(97, 99, 300), np.tile(r.integers(97, 99, 60), 4), np.full(150, 97)]).astype(np.uint8)
    starts = np.arange(len(data) - 50)
    order, same = suffixes.sorted_suffixes(data, starts, block)
    whole = data.tobytes()
    keys = [whole[i : i + 62] for i in order]
    assert sorted(order.tolist()) == starts.tolist() and keys == sorted(keys)
    assert same.tolist() == [False, *(a[:50] == b[:50] for a, b in zip(keys, keys[1:]))]


# --- decontamination -------------------------------------------------------------------------
def test_decontamination(spark):
    r = random.Random(5)
    items = [(i, prose(r.randint(12, 40), r) + ".\n" + prose(6, r)) for i in range(30)] + [(90, None), (91, ""), (92, "alone")]
    texts = [prose(300, r) for _ in range(20)]
    leaks = {(k, k) for k in range(10)}
    docs = [(k, texts[k] + " " + (items[k][1].upper() if k < 10 else "") + " " + prose(80, r)) for k in range(20)] + [(50, None), (51, "")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for size in (1 << 20, 400):
        assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, i, index_bytes=size).collect()} == leaks
    assert {x.doc_id for x in decontaminate.without_leaks(d, i).collect()} == {k for k, _ in docs} - set(range(10))
    assert decontaminate.find_leaks(d, i.limit(0)).count() == 0 and decontaminate.find_leaks(d.limit(0), i).count() == 0


@pytest.mark.parametrize("gap", [" " * 400_000, " " + "x" * 3_000_000 + " "])
def test_decontamination_across_a_long_gap(spark, gap):
    r = random.Random(15)
    question, answer = prose(30, r) + ".", prose(30, r)
    text = prose(300_000, r)[:800_000] + " " + question + gap + answer + " " + prose(200_000, r)
    d, i = spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(4, question + "\n" + answer)], "item_id bigint, text string")
    assert [x.item_id for x in decontaminate.find_leaks(d, i).collect()] == [4]
    assert decontaminate.without_leaks(d, i).count() == 0


@pytest.mark.parametrize("words", [3, 40])
def test_pieces_hold_each_run_of_words(words):
    r = random.Random(16)
    text = "".join(r.choice(WORDS) + " " * r.choice([1, 1, 1, 1, 90]) for _ in range(600)).encode()
    own = text.split()
    runs = {tuple(own[k : k + words]) for k in range(len(own) - words + 1)}
    for piece in B.pieces(np.frombuffer(text, np.uint8), words, 500):
        p = piece.tobytes().split()
        runs -= {tuple(p[k : k + words]) for k in range(len(p) - words + 1)}
    assert not runs


def test_block_max_wand_finds_all_above():
    r = random.Random(6)
    ix = decontaminate.build([(i, prose(r.randint(3, 30), r)) for i in range(300)])
    for _ in range(50):
        terms = sorted(r.sample(range(len(ix.terms)), 40))
        total = {}
        for t in terms:
            for k, x in zip(ix.postings[t][0], ix.postings[t][1], strict=True):
                total[k] = total.get(k, 0) + x
        assert {k for k, _ in decontaminate.block_max_wand(ix, terms, 0.25)} == {k for k, x in total.items() if x >= 0.25 - 1e-9}


# --- mixing ----------------------------------------------------------------------------------
def test_mixing(spark):
    r = random.Random(7)
    sizes = {"a": 900, "b": 60, "c": 10, None: 5}
    rows = [(n, prose(r.randint(1, 9), r), s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))] + [(5000, None, "a"), (5001, "", "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df, block_tokens=50).collect()
    tokens = {}
    for _, t, s in rows:
        tokens[s or ""] = tokens.get(s or "", 0) + len((t or "").split())
    budget, some = sum(tokens.values()), [t for t in tokens.values() if t]
    share = lambda a: [t**a / sum(x**a for x in some) for t in some]
    grid = np.linspace(0, 1, 20001)
    fits = [a for a in grid if mixing.entropy_of(share(a)) >= 0.97]
    alpha = max(max(fits), min(a for a in grid if max(w * budget / t for w, t in zip(share(a), some, strict=True)) <= 4))
    for s, t in tokens.items():
        took = sum(x.tokens for x in got if x.source == s)
        quota = t**alpha / sum(x**alpha for x in some) * budget if t else 0
        assert quota - 10 <= took <= quota + 1
        each = {}
        for x in got:
            if x.source == s:
                each[x.doc_id] = each.get(x.doc_id, 0) + 1
        assert max(each.values()) - min(each.values()) <= 1
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_with_plans_too_large_to_broadcast(spark, monkeypatch):
    r = random.Random(8)
    rows = [(n, prose(r.randint(1, 9), r), "a" if n % 3 else f"s{n % 40}") for n in range(400)] + [(None, None, None), (7, "", "a"), (7, "", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    small = sorted(map(str, mixing.mix(df, block_tokens=50).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted(map(str, mixing.mix(df, block_tokens=50).collect())) == small


# --- models ----------------------------------------------------------------------------------
def labelled(spark):
    r = random.Random(8)
    bad = ["vile" + x for x in ("a", "bb", "ccc")]
    rows = []
    for i in range(400):
        words = [r.choice(WORDS) for _ in range(r.randint(5, 60))] + ["the", "of"]
        if i % 4 == 0:
            words[r.randrange(len(words))] = r.choice(bad)
            words.insert(0, r.choice(bad))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxicity(spark):
    df = labelled(spark)
    model = toxicity.train(df.select("doc_id", "text"), df.where("doc_id % 3 <> 1").select("doc_id", "toxic"))
    got = toxicity.score(df.unionByName(spark.createDataFrame([(900, None, 0), (901, "", 0), (902, "word " * 400_000 + "vilea vilebb", 1)], df.schema)), model, keep=("doc_id", "toxic")).collect()
    held = [r for r in got if r.doc_id % 3 == 1 and r.doc_id < 900]
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    edge = {r.doc_id: r for r in got if r.doc_id >= 900}
    assert all(0 <= r.score <= 1 for r in got) and edge[900].predicted == edge[901].predicted == 0 and edge[902].predicted == 1
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    df = labelled(spark)
    marks = df.select("doc_id", "toxic")
    long = spark.createDataFrame([(k, "word " * 14_000 + f"onlyhere thelast{k}", 1) for k in (7001, 7002, 7003)], "doc_id bigint, text string, toxic int")
    rows, both = df.select("doc_id", "text").unionByName(long.select("doc_id", "text")), marks.unionByName(long.select("doc_id", "toxic"))
    texts = toxicity.labelled(rows.unionByName(rows.limit(1)).unionByName(spark.createDataFrame([(7004, "no label"), (None, "no id"), (7001, None)], "doc_id bigint, text string")), both)
    assert texts.count() == df.count() + 3 + 1
    # as many texts as there are, and the end of texts over 60,000 characters, count
    n = df.count() + 3
    words = toxicity.vocabulary(texts.withColumn("held", F.lit(False)), n)[0]
    assert toxicity.hashed_words(np.frombuffer(b"onlyhere", np.uint8), np.array([0, 8]))[0][0] in words
    # a shard's layout in files or tasks changes nothing, and several shards learn as well
    monkeypatch.setattr(toxicity, "SHARD", 1 << 12)
    one, two = (toxicity.train(x.select("doc_id", "text"), marks.where("doc_id % 3 <> 1")) for x in (df.coalesce(1), df.repartition(5, "text")))
    assert np.array_equal(one.out, two.out) and one.scale == two.scale
    held = [r for r in toxicity.score(df, one, keep=("doc_id", "toxic")).collect() if r.doc_id % 3 == 1]
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)


def test_toxicity_shuffles_no_text_to_find_labels(spark):
    r = random.Random(8)
    docs = [(r.randrange(-40, 40), prose(3, r)) for _ in range(150)] + [(None, "no id"), (3, None), (200, "no label"), (3, "null label")]
    marks = [(r.randrange(-60, 60), r.choice([0, 0, 1, None])) for _ in range(90)] + [(None, 1)]
    found = toxicity.labelled(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id int, toxic int"))
    want = {}
    for k, y in marks:
        if k is not None and y is not None:
            want[k] = max(y, want.get(k, 0))
    assert sorted((x.y, x._text) for x in found.collect()) == sorted((want[k], t) for k, t in docs if k in want and t is not None)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_toxicity_tells_marks_whose_bit_others_share(spark):
    keys = spark.range(240_000).select((F.col("id") % 3 == 0).alias("mark"), F.xxhash64("id").alias("h"))
    marks, others = (written(keys.where(c).select("h"), "keys") for c in ("mark", "not mark"))
    found = toxicity._known(marks, others.unionByName(marks))
    table = keys.toArrow()
    assert len(found[2]) > 1000 and np.array_equal(toxicity._among(found, table.column("h").to_numpy()), table.column("mark").to_numpy())


def test_language_id(spark):
    r = random.Random(9)
    letters = {"xx": "abcde", "yy": "mnopqé"}
    rows = [(i, " ".join("".join(r.choice(letters[lang]) for _ in range(5)) for _ in range(r.randint(1, 30))), lang) for i, lang in enumerate(["xx", "yy"] * 100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df.where("doc_id % 4 <> 2"))
    odd = spark.createDataFrame([(900, None, None), (901, "12 !", None), (902, "abcde " * 300_000, None)], df.schema)
    got = {x.doc_id: x for x in langid.identify(df.unionByName(odd), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i % 4 == 2)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und", "und", "xx"] and got[900].score == 0 and not got[901].accepted
    assert langid.identify(df.limit(0), langid.train(df.limit(0))).count() == 0


def test_lm(docs, none):
    model = lm.train(docs)
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    assert got[45 * 3].n_tokens == 0 and got[45 * 3].log_likelihood == 0 and got[45 * 3].mean_log_likelihood is None
    assert all(r.log_likelihood < 0 for r in got.values() if r.n_tokens)
    assert lm.score(none, lm.train(none)).count() == 0
    around = np.random.default_rng(0).integers(0, lm.PAD, (400, 4))
    token = around[:, 1] % 7
    w = lm.start()
    losses = [lm.step(w, around, token, 1.0) for _ in range(80)]
    assert losses[-1] < 0.6 * losses[0]
    p = sum(np.exp(lm.log_probabilities(w, np.array([3, t, 5]), np.zeros(3, int))[1]) for t in range(lm.PAD))
    assert abs(p - 1) < 1e-4


def test_lm_learns_from_every_place():
    row = np.repeat([0, 2, 3, 7], [1, 5, 2, 30])
    for rounds in (1, 2, 3):
        assert sorted(np.concatenate([lm.targets(row, r, rounds) for r in range(rounds)]).tolist()) == list(range(len(row)))
    assert lm.targets(row, 0, lm.ROUNDS).tolist()[:2] == [0, 1]


def test_lm_predicts_the_word(spark):
    rare = [f"rare{k}" for k in range(2000)]
    hashed = {w: toxicity.hashed_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0] for w in [*rare, *(f"absent{k}" for k in range(300))]}
    spots = {}
    for w, h in hashed.items():
        spots.setdefault(int(lm.classes(np.zeros(0, np.uint64), h)[0]), []).append(w)
    rows = [(k, " ".join(f"common{j}" for j in range(lm.FREQUENT)) * 2) for k in range(30)] + [(100 + k, " ".join([w] * (1 + k % 5))) for k, w in enumerate(rare)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    model = lm.train(df)
    assert model.counts.count() >= 2000 + lm.FREQUENT
    ask = spark.createDataFrame([(k, w) for k, w in enumerate(hashed)], "doc_id bigint, text string")
    p = {w: r.log_likelihood for r in lm.score(ask, model).collect() for w in [list(hashed)[r.doc_id]]}
    count = {w: 1 + k % 5 for k, w in enumerate(rare)}
    for own in spots.values():
        base = {p[w] - np.log(lm.SMOOTH + max(0, count.get(w, 0) - 1)) for w in own if hashed[w][0] not in model.frequent}
        assert max(base) - min(base) < 1e-6
        assert len({round(p[w], 6) for w in own}) > 1
    c = lm.FREQUENT
    own = [w for w in spots[c] if w in count and hashed[w][0] not in model.frequent]
    assert abs(model.sizes[0] - sum(count[w] + lm.SMOOTH for w in own) - lm.SMOOTH) < 1e-9


def test_chat(spark):
    r = random.Random(10)
    rows = [(c, t, role, (prose(5, r) + "?") if role == "user" else prose(30, r)) for c in range(60) for t, role in enumerate(["user", "assistant"] * r.randint(1, 4))]
    df = spark.createDataFrame([*rows, (None, 0, None, "a"), (99, None, "user", None), (98, 0, None, "User: hi there?\nAssistant: hello\nmore")], "conv_id bigint, turn bigint, role string, text string")
    model = chat.fit(df, "conv_id", "turn", "role", "text")
    key = lambda d: sorted((r.conv_id if r.conv_id is not None else -1, r.turn if r.turn is not None else -1, r.part, r.role_pred, r.rendered) for r in d.collect())
    got = key(chat.format_chats(df, model))
    assert got == key(chat.format_chats(df, model, segment=1)) == key(chat.format_chats(df, model, segment=3))
    want = {(c, t): role for c, t, role, _ in rows}
    assert sum(want[c, t] == role for c, t, _, role, _ in got if (c, t) in want) >= 0.9 * len(rows)
    assert [(p, role, text) for c, _, p, role, text in got if c == 98] == [(0, "user", "<|user|>\nhi there?\n<|end|>\n"), (1, "assistant", "<|assistant|>\nhello\nmore\n<|end|>\n")]
    assert chat.format_chats(df.limit(0), model).count() == 0


def test_chat_rows_without_a_place(spark):
    """Rows with a null conv or turn are decoded each by itself and leave the conversations as they are."""
    texts = ["User: hi?", "Assistant: hello\nthere", "plain", "", None, "User: a\nBot: b"]
    talks = [(c, t, "user" if t % 2 == 0 else "assistant", prose(5 + 20 * (t % 2))) for c in range(5) for t in range(4)]
    lost = [x for t in texts for x in [(1, None, None, t), (None, 7, None, t), (None, None, None, t), (None, 7, None, t)]]
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame([*talks, *lost], schema)
    model = chat.fit(df, "conv_id", "turn", "role", "text")
    got = chat.format_chats(df, model, segment=2).collect()
    key = lambda rows: sorted((r.part, r.role_pred, r.rendered) for r in rows)
    single = chat.format_chats(spark.createDataFrame([(k, 0, None, t) for k, (*_, t) in enumerate(lost)], schema), model).collect()
    assert key(r for r in got if r.conv_id is None or r.turn is None) == key(single)
    whole = chat.format_chats(spark.createDataFrame(talks, schema), model, segment=2).collect()
    assert key(r for r in got if r.conv_id is not None and r.turn is not None) == key(whole)


# --- URLs and sketches -----------------------------------------------------------------------
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "a.net", "/p/q"), ("block", "net", "/")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_urls(spark, limit):
    cases = ["http://Example.com/en/1", "https://www.example.com/en/", "http://x.example.com/en?q", "http://example.com", "http://b.a.net/p/qrs", "http://a.net/p/", "http://xa.net/es/1#f", "mailto:x", None, "", "http://org/x"]
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame([(c, "old") for c in cases], "url string, rule string"), RULES, max_trie_bytes=limit).collect()}
    assert got == {
        cases[0]: ("example.com", "/en/1", "example.com/en/", "block"), cases[1]: ("www.example.com", "/en/", "www.example.com/en/", "allow"), cases[2]: ("x.example.com", "/en", "com/", "allow"), cases[3]: ("example.com", "", None, "allow"),
        cases[4]: ("b.a.net", "/p/qrs", "a.net/p/q", "block"), cases[5]: ("a.net", "/p/", "net/", "block"), cases[6]: ("xa.net", "/es/1", "net/es/", "block"),
        cases[7]: ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), cases[10]: ("org", "/x", None, "allow"),
    }


def slow_sketch(text):
    words = [w for w in (text or "").split() if w]
    h = {hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:12] for i in range(max(1, len(words) - 4))} if words else set()
    return hashlib.md5((text or "").encode()).hexdigest()[:12] + "|" + ",".join(sorted(x for x in h if x < "4"))


def test_sketch(docs, rows):
    got = sketch.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    first = {k: t or "" for k, t, *_ in rows if k is not None and k != 9}
    ids = sorted(first)
    assert all(by_id[k].fingerprint == slow_sketch(first[k]) for k in ids)
    for a, b in zip(ids, ids[1:]):
        if a not in (6, 9) and b != 9:
            t, n = first[a], len(first[a]) // 4
            edited = t[: len(t) - n] + first[b][:n]
            assert by_id[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by_id[a].edited_fingerprint == slow_sketch(edited)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_sketch_merge_and_containment(spark):
    a, b = prose(400), prose(400)
    df = spark.createDataFrame([(a, b, a + " zz " + b)], "a string, b string, c string")
    r = df.select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"), sketch.sketch(F.col("c")).alias("c")).select(sketch.likeness(F.col("a"), F.col("c")).alias("x"), sketch.likeness(F.col("a"), F.col("b")).alias("y"), sketch.likeness(sketch.merge(F.array("a", "b")), F.col("c")).alias("z")).first()
    assert r.x == 1.0 and r.y < 0.05 and r.z == 1.0


def test_empty_tables(none):
    assert simhash.near_duplicates(none).count() == 0
    assert suffixes.remove_repeats(none).count() == 0
    assert sketch.fingerprint_documents(none).count() == 0
    assert urls.filter_urls(none.select(F.col("text").alias("url")), RULES).count() == 0
    assert toxicity.score(none, toxicity.train(none, none.select("doc_id", F.lit(1).alias("toxic")))).count() == 0


def test_suffix_removal_of_many_texts_is_that_of_brute_force(spark):
    r = random.Random(21)
    texts = [prose(r.randint(1, 80), r) for _ in range(120)]
    passages = [prose(30, r) for _ in range(4)]
    for k in range(120, 260):
        own = texts[r.randrange(120)]
        at = r.randrange(len(own) + 1)
        texts.append(own[:at] + r.choice(passages + [chr(97 + k % 9)]) + own[at:])
    rows = [(r.randrange(200), t) for t in texts] + [(None, texts[0])] * 3 + [(4, None), (4, texts[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for most in (20_000, 2):
        got = suffixes.remove_repeats(df, block_rows=30, hot_spans=most).collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, sum(e - s for s, e in zip(x.starts, x.ends)), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in got) == slow_repeats(rows)
    with pytest.raises(ValueError):
        suffixes.remove_repeats(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_mixing_keeps_the_weights_in_each_part_of_the_order(spark):
    r = random.Random(22)
    rows = [(k, prose(20, r), "a") for k in range(6000)] + [(6000 + k, prose(20, r), "b") for k in range(300)] + [(7000 + k, prose(20, r), None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(mixing.mix(df, block_tokens=2000, carry=("text",)).collect(), key=lambda x: x.place)
    whole = {s: sum(x.tokens for x in got if x.source == s) / sum(x.tokens for x in got) for s in ("a", "b", "")}
    for k in range(10):
        part = got[len(got) * k // 10 : len(got) * (k + 1) // 10]
        for s, share in whole.items():
            assert abs(sum(x.tokens for x in part if x.source == s) / sum(x.tokens for x in part) - share) < 0.04
    assert all(x.text == rows[x.doc_id if x.doc_id < 6300 else x.doc_id - 700][1] for x in got)


def test_decontamination_at_a_low_threshold(spark):
    r = random.Random(23)
    items = [(f"i{k}", prose(30, r) + ".\n" + prose(8, r)) for k in range(12)]
    texts = [(k, prose(20, r) + " " + " ".join(w if r.random() < 0.5 else "zzz" for w in items[k % 12][1].split())) for k in range(60)]
    d, i = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    ix = decontaminate.build(sorted(items), 0.2)
    want = set()
    for k, t in texts:
        term = decontaminate._lookup(ix.terms, decontaminate._words(t))
        want |= {(k, ix.ids[m]) for m, _ in decontaminate.block_max_wand(ix, (np.unique(term[term > 0]) - 1).tolist(), 0.2)}
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, i, threshold=0.2, overlap=0.0).collect()} == want and want
    with pytest.raises(ValueError):
        decontaminate.find_leaks(d, i, threshold=0.0)


def test_letters():
    assert [langid.has_letter(np.frombuffer(t.encode(), np.uint8)) for t in ("½ ²", "Ⅷ 12", "é", "x", "", "12 語")] == [False, False, True, True, False, True]


def slow_scores(model, texts):
    """The pseudo-likelihood of each text, word by word."""
    counts, out = {r.word: r.n for r in model.counts.collect()}, []
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    for t in texts:
        raw, offsets = B.column_bytes(pa.array([t]), lower=True)
        words = toxicity.hashed_words(raw, offsets)[0]
        token, total = lm.classes(model.frequent, words).tolist(), 0.0
        for i, c in enumerate(token):
            h = sum((w["E"][token[i + d] if 0 <= i + d < len(token) else lm.PAD] @ w["A"][k] for k, d in enumerate(d for d in range(-lm.SIDE, lm.SIDE + 1) if d)), np.zeros(lm.DIM))
            z = np.tanh(h) @ w["O"] + w["b"]
            total += z[c] - np.log(np.exp(z).sum())
            if c >= lm.FREQUENT:
                total += np.log((max(0, counts.get(int(words[i].view(np.int64)), 0) - 1) + lm.SMOOTH) / model.sizes[c - lm.FREQUENT])
        out.append(total)
    return out


def test_lm_scores_are_the_pseudo_likelihood_in_any_layout(spark):
    r = random.Random(24)
    texts = [prose(r.randint(1, 200), r) for _ in range(60)] + ["", "Zürich été", prose(30, r) + " zzz" * 40]
    texts.append(texts[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    models = [lm.train(df.repartition(n), key="doc_id") for n in (1, 7)]
    assert all(np.array_equal(models[0].w[k], models[1].w[k]) for k in models[0].w)
    got = {x.doc_id: x.log_likelihood for x in lm.score(df.repartition(5), models[0]).collect()}
    want = slow_scores(models[1], texts)
    assert all(abs(got[k] - x) < 1e-3 * max(1, abs(x)) for k, x in enumerate(want)) and abs(got[0] - got[len(texts) - 1]) < 1e-3


def test_lm_scores_a_text_of_several_pieces_as_one(spark, monkeypatch):
    r = random.Random(25)
    texts = [prose(250_000, r), prose(40, r)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = lm.train(df)
    got = {x.doc_id: (x.n_tokens, x.log_likelihood) for x in lm.score(df, model).collect()}
    raw, offsets = B.column_bytes(pa.array(texts), lower=True)
    words, _, bounds = toxicity.hashed_words(raw, offsets)
    token, counts = lm.classes(model.frequent, words), {x.word: x.n for x in model.counts.collect()}
    each = lm.log_probabilities(model.w, token, np.repeat(np.arange(2), np.diff(bounds)))
    rare = token >= lm.FREQUENT
    each[rare] += [np.log((counts[int(h)] - 1 + lm.SMOOTH) / model.sizes[c - lm.FREQUENT]) for h, c in zip(words[rare].view(np.int64), token[rare], strict=True)]
    for k in range(2):
        assert got[k][0] == bounds[k + 1] - bounds[k] and abs(got[k][1] - each[bounds[k] : bounds[k + 1]].sum()) < 1e-3 * abs(got[k][1])
    assert len(raw) > B.PIECE


def test_sketches_of_short_texts_merge(spark):
    r = random.Random(26)
    short = [prose(r.randint(1, 12), r) for _ in range(60)]
    long = " yy ".join(prose(20, r) + " " + t for t in short)
    df = spark.createDataFrame([(short, long, "", "one")], "a array<string>, b string, c string, d string")
    each = F.transform("a", lambda t: sketch.sketch(t))
    got = df.select(sketch.hashes_of(sketch.merge(each)).alias("m"), each.alias("e"), sketch.likeness(sketch.merge(each), sketch.merge(F.array_append(each, sketch.sketch(F.col("b"))))).alias("x"), sketch.likeness(sketch.sketch(F.col("c")), sketch.sketch(F.lit(None).cast("string"))).alias("same"), sketch.likeness(sketch.sketch(F.col("c")), sketch.sketch(F.col("d"))).alias("other")).first()
    assert set(got.m) == {h for t in short for h in slow_sketch(t).split("|")[1].split(",") if h} and got.m
    assert got.x == 1.0 and got.same == 1.0 and got.other == 0.0
