"""The operators on DataFrames: odd rows, empty tables, clashing columns, and brute force on small fixtures."""

import hashlib
import math
import random
import textwrap
import types
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row

import corpus_pipeline
from quire.llm import bpe, chat, common, license, minhash, mixing, pii, quality, secrets, spans, toxicity, vectors

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ", size long, kept string, component string, digest string, source_size string, spans string, n string, v string, rep string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + CLASH
EXTRA = (1, "k", "c", "d", "s", "p", "n", "v", "r")


def make(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def odd_rows():
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, "some text without an id that is long enough to be kept here", "en", "a", 5),
        (3, "same same", None, "b", 9),
        (3, "same same", None, "b", 9),
        (4, long, "en", "b", len(long)),
        (5, "a\x00b é 😀 \x85 mail me@x.org", "fr", None, 3),
    ]


OPERATORS = {
    "quality": lambda d: quality.assess(d),
    "secrets": lambda d: secrets.scan(d, VOCABULARY),
    "pii": lambda d: pii.find(d),
    "bpe": lambda d: bpe.tokenize(d, VOCABULARY),
    "mixing": lambda d: mixing.mix(d),
    "minhash": lambda d: minhash.near_duplicates(d),
    "license": lambda d: license.scan(d),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    rows = odd_rows()
    out = OPERATORS[name](make(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert OPERATORS[name](make(spark, rows).where("false")).collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows_and_empty_tables(spark, stage):
    name, f = corpus_pipeline.STAGES[stage]
    docs = make(spark, odd_rows())
    out = f(spark, docs, "")
    out.collect()
    assert f(spark, docs.where("false"), "").collect() == []
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == common.DOCUMENT_COLUMNS


def test_one_row_of_an_id_stays(spark):
    docs = make(spark, [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1), (None, "a b c d e f g", "en", "s", 1), (9, None, "en", "s", 1)])
    assert sorted((r["doc_id"] or -1) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [-1, 1, 9]


def test_texts_of_one_id_are_told_apart(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    docs = make(spark, [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "s", 1), (3, None, "en", "s", 1), (3, None, "en", "s", 1), (4, c, "en", "s", 1)])
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == {(1, a): 1, (1, b): 1, (3, c): 1, (3, None): 1}


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(rng):
    """Groups of edited copies, a hub with spokes, a passage that many share, and others."""
    texts = []
    for size in (2, 5, 40):
        base = words(rng, rng.randint(30, 160))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(w[: len(w) - rng.randint(0, 12)])
    passage = words(rng, 60)
    texts += [words(rng, rng.randint(5, 60)) + passage for _ in range(40)]
    texts += [words(rng, rng.randint(0, 8), 3) for _ in range(60)]
    texts += texts[:10]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def brute_near(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(texts)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_match_brute_force(spark, seed):
    texts = near_copies(random.Random(seed))
    docs = make(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got == brute_near(texts)


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors_match_brute_force(spark, block):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    x = [base[i % 12] + rng.standard_normal(16) * rng.choice([0.05, 0.15, 0.6]) for i in range(150)]
    x += x[:5]
    rows = [(i, [float(a) for a in np.float32(v)]) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, []), (None, rows[0][1]), (1005, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "l", 1) for r in rows], "vec_id long, embedding array<float>, label string, rep int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df, vectors.Hashing(bucket=20, block=block, recall=1 - 1e-9)).collect()}
    u = np.array([np.float32(v) for v in x], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.array([low[near[i]].min() for i in range(len(x))])
    for i in range(len(x)):
        assert got[i] == (near[i].sum() - 1, low[i], low[i] == i)
    for i in range(1000, 1006):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False)
    assert vectors.near_duplicates(df.where("false")).collect() == []


def test_components_match_brute_force(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (7, None)]
    low = {}

    def find(i):
        low.setdefault(i, i)
        while low[i] != i:
            i = low[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            low[y] = x
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in low}


def test_bitmap_lets_all_its_keys_through(spark):
    keys = [0, 1, -1, 63, 64, -(1 << 63), (1 << 63) - 1, 12345678901234]
    data = common.bitmap(spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long"), "k")
    assert common.BitmapTest(data)(np.array(keys)).all()
    assert not common.BitmapTest(data)(np.array([2, 62, 65])).any()


def mixture(sizes, weights=(1, 2, 3)):
    """Targets by resharing the excess, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target | {s: 3 * sizes[s] for s in capped}
        capped |= over


def test_targets_match_resharing(spark):
    rng = random.Random(6)
    for _ in range(3):
        sizes = {s: rng.choice([0, 3, 50, 1000, 30_000]) for s in ["a", "b", "B", "é", "z", None]}
        df = spark.createDataFrame([Row(source=s, source_size=n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = mixture(sizes)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes), (sizes, got, want)


def test_mix_comes_near_its_targets_and_repeats(spark):
    docs = make(spark, [(i, "word " * (i % 17 + 1), "en", "abc"[i % 3 if i % 5 else 0], 0) for i in range(3000)])
    rows = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    assert all(abs(taken[s] - t) < 0.1 * t for s, t in target.items())
    copies = Counter(r["doc_id"] for r in mixing.mix_sources(docs).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def brute_disclosure(texts, rules):
    """Hash of a term: its largest P(entity | term), counted pair by pair."""
    n_term, n_both, n_entity, support = Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        for w in {pii.term(w) for w in t.split()}:
            n_term[w] += 1
        found = spans.personal(t)
        for e in {f"{k}:{t[a:b].lower()}" for k, a, b in found}:
            n_entity[e] += 1
            support[e].add(t)
        for e, w in pii.near(t, found, rules):
            n_both[e, w] += 1
            support[e, w].add(t)
    out = {}
    for (e, w), n in n_both.items():
        p, bits = n / n_term[w], math.log2(len(texts) * n / (n_term[w] * n_entity[e]))
        if len(support[e, w]) >= rules.min_texts and len(support[e]) >= rules.min_texts and p >= rules.general and bits >= rules.min_bits:
            out[pii._hash(w)] = max(p, out.get(pii._hash(w), 0))
    return out


def test_rows_without_ids_are_mixed_one_by_one(spark):
    docs = make(spark, [(None, f"word{i} " * 10, "en", "abc"[i % 3], 0) for i in range(900)])
    out = mixing.mix(docs).groupBy("source", "target").agg({"copies": "sum"}).collect()
    assert all(abs(10 * r["sum(copies)"] - r["target"]) < 0.1 * r["target"] for r in out) and len(out) == 3


def test_scratch_is_shared_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    def at(master):
        return common.scratch_dir(types.SimpleNamespace(conf=Conf, sparkContext=types.SimpleNamespace(master=master)))

    assert at("local[*]").startswith("file:") and at("local") and at("local[4,2]")
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            at(master)


def test_disclosing_terms_match_brute_force(spark):
    rng = random.Random(9)
    rules = pii.Disclosure(min_texts=3, min_bits=2.0)
    people = [("zorblatt", "zor@x.com"), ("quillon", "+1 (456) 555-2186"), ("common", "9.9.9.9")]
    texts = []
    for i in range(300):
        w = [rng.choice(["lorem", "ipsum", "dolor", "common", "amet"]) for _ in range(12)]
        if i % 10 == 0:
            name, entity = people[i // 10 % 3]
            w[rng.randrange(4, 8)] = f"{name.title()}, {entity} x{i}"
        texts.append(" ".join(w))
    texts += texts[:40] + ["Zorblatt again"]
    docs = make(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(docs, rules).collect()}
    assert got and got == pytest.approx(brute_disclosure(texts, rules))
    out = {r["doc_id"]: r["text"] for r in pii.sanitise_documents(docs, rules).collect()}
    assert not any("zor@x.com" in t or "orblatt" in t for t in out.values())
    # Found spans and masked texts agree, and base spans stay.
    for r in pii.find(docs, rules).collect():
        s = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert pii.sanitise(texts[r["doc_id"]], s) == out[r["doc_id"]]
        assert {x for x in s if x[0] in pii.KINDS[:4]} == set(spans.personal(texts[r["doc_id"]]))


@pytest.mark.parametrize("total, share", [(40, 3), (300, 3), (300, 2), (30, 5)])
def test_frequent_entities_have_disclosing_terms(spark, total, share):
    """A contact in a half, a third or a fifth of the documents, in small tables too; common words stay."""
    rng = random.Random(total)
    filler = ["lorem", "ipsum", "dolor", "amet"]
    texts = [" ".join(rng.choice(filler) for _ in range(8)) + f" no{i}" + (" ask Zorblatt at zor@x.com" if i % share == 0 else "") for i in range(total)]
    docs = make(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r["term"]: r["kind"] for r in pii.disclosing_terms(docs).collect()}
    assert got[pii._hash("zorblatt")] == "remove" and not {pii._hash(w) for w in filler} & set(got)


def test_any_term_of_a_document_may_disclose(spark):
    """Short names, apostrophes, hyphens, digits, and far from the entity, on another line."""
    names = ["Kim", "O'Brien", "Anne-Marie", "user_77", "48213", "李"]
    filler = "lorem ipsum dolor amet " * 10
    texts = [f"{names[i % 6]}, {filler}\n{filler} no{i} p{i % 6}@x.com" if i % 5 == 0 else f"{filler} no{i}" for i in range(600)]
    docs = make(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r["term"]: r["kind"] for r in pii.disclosing_terms(docs).collect()}
    assert got == {pii._hash(n.lower()): "remove" for n in names}
    out = [r["text"] for r in pii.sanitise_documents(docs).collect()]
    assert not any(n in t for n in names for t in out)


def test_chat_streams_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\### </turn>"), (1, 1, "assistant", "\\### </turn>"), (2, 5, None, None), (None, None, "assistant", "x"), (3, 2, "assistant", "b"), (3, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, n_turns string").repartition(3)
    got = {r["conv_id"]: r for r in chat.round_trip(df).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nhi\n" + "assistant\n\\### </turn>\n" * 2)
    assert got[1]["loss_sha256"] == sha("\\### </turn>" * 2) and got[1]["loss_chars"] == 24
    assert got[2]["turns_sha256"] == sha("\n\n") and got[None]["n_turns"] == 1
    assert got[3]["turns_sha256"] == sha("user\na\nassistant\nb\n")
    assert got[3]["formatted_chars"] == len(chat.format_conversation([("user", "a"), ("assistant", "b")]))
    assert chat.round_trip(df.where("false")).collect() == []
    rendered = sorted(chat.render(df.where("conv_id = 3")).collect(), key=lambda r: r["turn"])
    assert "".join(r["rendered"] for r in rendered) == chat.format_conversation([("user", "a"), ("assistant", "b")])


def test_licenses_in_other_spellings(spark):
    mit = dict(license.LICENSES)["ISC"]
    texts = [mit.upper(), "Copyright (c) 2020 A. Person\n" + mit.replace(".", " . "), mit + " more", "x\n  licensed under the apache LICENCE -- version 2.0\ny", None, ""]
    got = {r["doc_id"]: (r["text_license"], r["licenses"]) for r in license.scan(make(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    assert got == {0: ("ISC", "ISC"), 1: ("ISC", "ISC"), 2: (None, ""), 3: (None, "Apache-2.0"), 4: (None, ""), 5: (None, "")}


def test_licenses_in_paragraphs_and_further_texts(spark):
    gpl = next(t for i, t in license.LICENSES if i == "AGPL-3.0")
    wrapped = "# a script\n#\n# " + "\n# ".join(textwrap.wrap(gpl, 40)) + "\n#\n# and so on"
    more = spark.createDataFrame([("X-2", "do what you like"), ("X-1", "Do what, you like!"), ("X-3", None), (None, "x")], "license string, text string")
    docs = make(spark, [(i, t, "en", "s", 0) for i, t in enumerate([wrapped, wrapped.replace("Affero", "Other"), "DO WHAT YOU LIKE"])])
    got = {r["doc_id"]: (r["text_license"], r["licenses"]) for r in license.scan(docs, more).collect()}
    assert got == {0: (None, "AGPL-3.0"), 1: (None, ""), 2: ("X-1", "X-1")}
    with pytest.raises(ValueError):
        license.known(spark, spark.range(license.MOST_KNOWN).selectExpr("'x' AS license", "cast(id AS string) AS text"))


def test_pipeline_matches_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(12)
    texts = near_copies(rng)
    texts[3:6] = ["x " * 40, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    kept = np.flatnonzero(quality.measure(texts, quality.Rules())["kept"]).tolist()
    stay = [kept[i] for i, _, low in brute_near([texts[i] for i in kept]) if low == i]
    sizes = Counter()
    for i in stay:
        sizes["ab"[i % 2]] += len(texts[i].split())
    target = mixture(sizes)
    want, encoder = Counter(), bpe._encoder(open(VOCABULARY).read())
    for i in stay:
        rate = target["ab"[i % 2]] / sizes["ab"[i % 2]]
        draw = int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:13], 16) / (1 << 52)
        if copies := math.floor(rate) + (draw < rate - math.floor(rate)):
            want[i, len(encoder.encode(texts[i])), hashlib.sha256(texts[i].encode()).hexdigest()] = copies
    assert got == want


def test_held_out_labels_are_not_learnt(spark):
    texts = [(i, "good words only" if i % 2 else "bad vile words", "en", "s", 0) for i in range(200)]
    docs = make(spark, texts)
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(200)], "doc_id long, t boolean").selectExpr("doc_id", "cast(t as int) AS toxic")
    flipped = labels.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["x"]).expr("CASE WHEN crc32(cast(doc_id as string)) % 4 = 2 THEN 1 - toxic ELSE toxic END"))
    a, b = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.table, b.table)
    rows = toxicity.score(docs, a).collect()
    assert all(r["predicted"] == (r["doc_id"] % 2 == 0) for r in rows)
