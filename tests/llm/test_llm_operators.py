"""Operators of the training-data subpackage: edge cases with defined results, and brute force
or exact round trips where SQL cannot express an operator. (The SQL oracles of op1, op5, op6 and
op10 run in tests/test_oracles.py with all other queries.)"""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from geoflat.llm import (bfd_pack, content_sort, crf_extract, labelled, license_scan, minhash_oph,
                         pareto_mix, pattern_pack, quality_ftrl, quality_rules, tokens, toxicity_cf,
                         turn_repair, warc_merkle, whitening)
from geoflat.llm.common import ship_package, table, word_count

WS = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, size int, kept int"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in any column, blank, tiny and very long texts, ties, repeated rows, and columns
    with names that the operators use themselves."""
    ship_package(spark)
    rng = random.Random(3)
    words = ["w%d" % rng.randrange(4000) for _ in range(60000)]
    long_ = " ".join(words)
    base = " ".join(words[:200])
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, " a\n"), (None, "a b c d e"), (None, "a b c d e"),
            (7, base), (8, base), (8, base), (9, base + " tail"), (10, base.replace(" ", "\n")), (11, long_),
            (12, long_ + " end"), (13, "x y z"), (14, "X Y Z"), (15, " word  next"), (16, base[:600])]
    return spark.createDataFrame(
        [(i, t, [None, "en", "xx"][k % 3], [None, "s1", "s2", "s1"][k % 4], None, "r", 7, k)
         for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return table(spark, SF_SMALL, "documents")


def norm(t):
    return WS.sub("", t or "")


def test_content_sort_edges(edge):
    got = content_sort.content_sort(edge)
    rows = got.select(F.col("row.doc_id").alias("i"), F.col("row.text").alias("t"), "keep_id", "group_size",
                      "kept", "text_sha256").collect()
    assert len(rows) == edge.count()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r["t"]), []).append(r)
    for members in groups.values():
        best = min(members, key=lambda r: (-len(r["t"] or ""), r["i"] is None, r["i"] or 0))
        assert {r["keep_id"] for r in members} == {best["i"]}
        assert {r["group_size"] for r in members} == {len(members)}
        assert sum(r["kept"] for r in members) == 1
    kept = content_sort.kept_rows(edge)
    assert kept.columns == edge.columns and kept.count() == len(groups)


def test_content_sort_slices_hot_groups(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, F.lit("hot text"))
                                 .otherwise(F.col("id").cast("string")).alias("text"))
    rows = content_sort.content_sort(df).select("row.doc_id", "keep_id", "group_size", "kept").collect()
    assert sum(r["kept"] for r in rows) == 101
    assert all(r["keep_id"] == 0 and r["group_size"] == 400 for r in rows if r["doc_id"] < 400)


def brute_near(rows, k=4):
    sets = {}
    for i, t in rows:
        w = WS.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        w = [x for x in w if x]
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        c = len(sets[a] & sets[b])
        if c and 100 * c >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_edges(edge):
    known = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash_oph.near_duplicates(known).collect()}
    assert got == brute_near([(r["doc_id"], r["text"]) for r in known.collect()])
    assert minhash_oph.near_duplicates(edge).count() == edge.count()


def test_near_duplicates_tell_rows_apart_by_place(spark):
    """Repeated ids with different texts, null ids and text ids, against brute force over rows."""
    a = ["a%d" % k for k in range(100)]
    b = a[:80]                       # 77 of the 97 shingles of a: not linked
    x = a[:92] + ["x%d" % k for k in range(4)]
    n = ["n%d" % k for k in range(60)]
    rows = [(1, a), (1, b), (2, x), (None, n), (None, n + ["end"]), (None, n), (7, b + ["t"]), (None, a[:50]), (8, ["q"]), (8, ["q"])]
    rows = [(i, " ".join(t)) for i, t in rows]
    groups = brute_near(list(enumerate(t for _, t in rows)))
    for kind, name in (("bigint", int), ("string", lambda v: f"d{v}")):
        data = [(None if i is None else name(i), t) for i, t in rows]
        df = spark.createDataFrame(data, f"doc_id {kind}, text string").coalesce(1)
        got = minhash_oph.near_duplicates(df).collect()
        want = []
        for k, (i, t) in enumerate(data):
            ids = [data[j][0] for j in range(len(data)) if groups[j][1] == groups[k][1]]
            want.append((i, groups[k][0], min((v for v in ids if v is not None), default=None)))
        assert sorted(map(str, want)) == sorted(str((r["id"], r["n_shingles"], r["component_id"])) for r in got)
        assert sum(r["stays"] for r in got) == len({g[1] for g in groups.values()})


def test_near_duplicates_mixed_group(spark):
    """A group whose members are partly below the limit: stars alone would lose links."""
    rng = random.Random(11)
    base = ["b%d" % k for k in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for p in rng.sample(range(120), rng.randint(0, 5)):
            w[p] = "c%d" % rng.randrange(10 ** 6)
        rows.append((i, " ".join(w)))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in
           minhash_oph.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_near(rows)


def test_block_links_are_a_spanning_forest():
    import pandas as pd
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 300)
    sets = []
    for _ in range(50):
        s = base.copy()
        s[rng.choice(300, int(rng.integers(5, 60)), replace=False)] = rng.integers(0, 1 << 60, 1)
        sets.append(np.unique(s))
    pdf = pd.DataFrame({"id": range(50), "component": range(50), "part": 0, "shingles": sets})
    found = minhash_oph._block_links(pdf, 80)
    for a, b in found.itertuples(index=False):
        c = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)
    assert len(found) <= 49


def test_signature_of_tiny_sets_is_full():
    for n in (1, 2, 5):
        s = minhash_oph.signature(np.arange(1, n + 1, dtype=np.uint64))
        assert len(s) == minhash_oph.BINS and (s != 0).all()


def mixed(df):
    rows = pareto_mix.mix(df).select("row.source", "size", "source_size", "target", "copies").collect()
    by = {}
    for r in rows:
        assert 0 <= r["copies"] <= 3
        x = by.setdefault(r["source"], [0, 0, r["target"], 0])
        x[0] += r["size"]
        x[1] += r["size"] * r["copies"]
        x[3] = max(x[3], r["size"])
    return rows, by


def test_pareto_mix_targets(docs):
    rows, by = mixed(docs)
    total = sum(x[0] for x in by.values())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by))}
    capped = set()
    while True:
        rate = (total - sum(3 * by[s][0] for s in capped)) / sum(weight[s] for s in by if s not in capped)
        more = {s for s in by if s not in capped and rate * weight[s] > 3 * by[s][0]}
        if not more:
            break
        capped |= more
    for s, (size, taken, target, largest) in by.items():
        assert target == pytest.approx(3 * size if s in capped else rate * weight[s])
        assert abs(taken - target) <= max(0.02 * target, largest)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixed(docs.repartition(5))[0]))


def test_pareto_mix_edges(edge, spark):
    rows, by = mixed(edge)
    assert len(rows) == edge.count() and None in by
    assert all(r["copies"] == 0 for r in rows if r["size"] == 0)
    assert pareto_mix.mixed_rows(edge).columns == edge.columns
    assert pareto_mix.mix(edge.limit(0)).count() == 0


def test_pareto_mix_draws_rows_without_id_one_by_one(spark):
    rows = [(None, "a b c d e", "s1")] * 3000 + [(k, "x y z %d" % k, "s%d" % (1 + k % 2)) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    _, by = mixed(df)
    for size, taken, target, largest in by.values():
        assert abs(taken - target) <= largest
    none = pareto_mix.mix(df.where("doc_id is null")).agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert abs(none - 15000) <= 5


def test_word_count(edge):
    for r in edge.select("text", word_count(F.coalesce("text", F.lit(""))).alias("n")).collect():
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))


def whole_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_table_gives_the_tokenizers_ids(docs):
    e = tokens.Encoder.get(tokens.VOCABULARY)
    texts = [r["text"] for r in docs.limit(60).collect()] + [
        "it's the DOG's 2nd x<|endoftext|>y <|startoftext|>", "İ ΣΑΣ é á", "a b c \U0001f600!?", "", "don't-stop ''s"]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == whole_ids(t)[:-1]


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_pattern_packing(which, request):
    df = request.getfixturevalue(which)
    rows = pattern_pack.packed_pieces(df).collect()
    total, by = sum(r["length"] for r in rows), {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-total // 4096) * 1.03 + 2
    want = sorted((r["doc_id"] or -1, p, len(ids[4096 * p:4096 * (p + 1)]),
                   zlib.crc32(np.array(ids[4096 * p:4096 * (p + 1)], "<u4").tobytes()))
                  for r in df.collect() for ids in [whole_ids(r["text"])] for p in range(-(-len(ids) // 4096)))
    assert sorted((r["id"] or -1, r["piece"], r["length"], r["ids_crc32"]) for r in rows) == want


def test_fit_patterns_uses_every_piece_once():
    rng = np.random.default_rng(2)
    hist = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 1025, 5000), return_counts=True))}
    plan = pattern_pack.fit_patterns(hist, 1024, 64, 3)
    used = {}
    for lengths, r in plan:
        assert sum(x * c for x, c in lengths.items()) <= 1024
        for x, c in lengths.items():
            used[x] = used.get(x, 0) + c * r
    assert used == hist
    assert pattern_pack.fit_patterns({}, 1024) == []


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 30)), rng.random(12)
    x = pattern_pack.nnls(a, b)
    y = np.zeros(30)
    for _ in range(20000):
        y = np.maximum(0, y - a.T @ (a @ y - b) / np.linalg.norm(a, 2) ** 2)
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_packed_matrix_round_trip(which, request):
    df = request.getfixturevalue(which)
    parts = {}
    for r in bfd_pack.packed_matrix(df, shard_chars=400_000).collect():
        ids, pos = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        ends = r["cu_seqlens"]
        assert len(ids) == len(pos) == 4096 and ends[0] == 0 and ends[-1] <= 4096
        for k, doc in enumerate(r["seg_doc"]):
            low, high = ends[k], ends[k + 1]
            assert pos[low:high].tolist() == list(range(high - low))
            parts.setdefault((doc, r["seg_piece"][k], r["seg_start"][k]), []).append(ids[low:high].tolist())
    want = {}
    for r in df.collect():
        ids = whole_ids(r["text"])
        for p in range(-(-len(ids) // 4096)):
            want.setdefault((r["doc_id"], p, p * 4096), []).append(ids[p * 4096:(p + 1) * 4096])
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}


def test_capacity_tree_finds_the_fullest_row():
    rng = random.Random(5)
    tree, open_ = bfd_pack.CapacityTree(100), []
    for row in range(400):
        need = rng.randint(1, 100)
        want = min((f for f, _ in open_ if f >= need), default=None)
        got = tree.take(need)
        assert (got and got[0]) == want
        if got:
            open_.remove(got)
        free = rng.randint(0, 100)
        tree.add(free, row)
        open_.append((free, row))


@pytest.mark.parametrize("method,label,low", [(quality_ftrl, "quality", 0.95), (toxicity_cf, "toxic", 0.75)])
def test_classifiers_hold_out(spark, docs, edge, method, label, low):
    big = spark.read.parquet(SF_SMALL.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(SF_SMALL.replace("0.001", "0.01") + "/labels.parquet")
    model = method.fit(big, labels)
    got = big.select("doc_id", method.scored(big, model).alias("s")).join(labels, "doc_id").where(
        labelled.fold(F.col("doc_id"), method.FOLDS) == method.HELD_OUT).toPandas()
    hit = (got["s"] >= 0.7).astype(int)
    assert np.mean([(hit[got[label] == k] == k).mean() for k in (0, 1)]) >= low
    scores = [r["s"] for r in edge.select(method.scored(edge, model).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in scores)
    none = method.fit(big, labels.limit(0))
    assert {r["s"] for r in edge.select(method.scored(edge, none).alias("s")).collect()} == {0.5}


def test_counterfactuals_are_tied():
    rng = random.Random(1)
    sentences, y = [], []
    for k in range(400):
        bad = k % 2
        group = "muslim" if bad and k % 8 else "christian"
        words = ["t%d" % rng.randrange(50) for _ in range(8)] + [group] + (["vile"] if bad and k % 3 else [])
        sentences.append(" ".join(words))
        y.append(bad)
    sample = labelled.Sample.of(y, [toxicity_cf.featurize(s) for s in sentences])
    pairs = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for k, s in enumerate(sentences)
             for x, z in toxicity_cf.counterfactuals(s, k)
             for a, b in [(toxicity_cf.featurize(x)[0], toxicity_cf.featurize(z)[0])]]

    def gap(fairness):
        m = toxicity_cf.train(sample, pairs, fairness=fairness)
        w = dict(zip(m.kept.tolist(), m.weights))
        return sum(w.get(h, 0) for h in toxicity_cf.entries_of("muslim"))
    assert gap(5.0) < 0.3 * gap(0.0)


def test_main_text_of_known_layouts(spark):
    pages = [r["html"] for r in table(spark, SF_SMALL, "pages").limit(120).collect()]
    model = crf_extract.train(crf_extract.training_set(pages[:80], 2), 120)
    wrong = total = 0
    for k, p in enumerate(pages[80:]):
        s = [x for b in crf_extract.leaf_blocks(p) for x in re.split(r"(?<=[.!?]) ", b.text)]
        source, labels = crf_extract.labelled_page(s, random.Random(10 ** 6 + k))
        got = model.decode(model.scores(crf_extract.leaf_blocks(source)))
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong <= 0.03 * total
    page = ("<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1>"
            "<p>One  two\n three.<script>var x='<p>no</p>'</script><p>Caf&eacute; &lt;x&gt; <b>bold</b>, said so."
            "<div class=ad>Buy now</div></article><footer>&copy; me</footer>")
    assert crf_extract.main_text(page, model) == "A & B\nOne two three.\nCafé <x> bold, said so."
    assert crf_extract.main_text(None, model) == "" == crf_extract.main_text("", model)


def test_leaf_blocks_keep_objects_and_formulas():
    def texts(page):
        return [b.text for b in crf_extract.leaf_blocks(page)]
    assert texts("<p>So <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds.</p><p>B</p>") == ["So x = 2 holds.", "B"]
    assert texts("<p>A <object data=f>fallback</object> c</p>") == ["A fallback c"]
    assert texts("<p>A <svg><title>t</title><style>s{}</style><text>drawn</text></svg> c</p>") == ["A drawn c"]
    for tag in ("object", "math", "svg"):
        assert texts(f"<div><p>A <{tag}>b</p><p>C</p></div><p>D</p>") == ["A b", "C", "D"]
        assert texts(f"<p>A <{tag}/> b</p>") == ["A b"]
    assert texts("<p>A<iframe>x</iframe><noscript>y</noscript><template>z</template> b</p>") == ["A b"]


def test_parser_is_linear_on_hostile_pages():
    import time
    pages = ['<a "' * 25000, "<a b=c " * 14000, "<div>x" * 17000, '<a ""' * 20000 + '">"', "<svg><title>" * 8000,
             "<b><p>" + "<i>" * 14000 + "</b>" * 14000, "<div>" * 8000 + "<head><body>" * 4000]
    model = crf_extract.CrfModel({"in:div": 1.0}, [[0.0, 0.0], [0.0, 0.0]])
    for page in pages:
        start = time.process_time()
        crf_extract.main_text(page, model)
        assert time.process_time() - start < 4, page[:20]  # the previous parser took minutes


def test_main_text_edges(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "t", 1), (None, None, "", "t", 1), (3, "u", "<p>" + "word " * 50_000 + "</p>", "t", 1)]
    pages = spark.createDataFrame(rows + [rows[2]] * 3, schema)
    for part in (pages, pages.limit(0)):
        model = crf_extract.fit(part)
        got = part.select("page_id", crf_extract.extracted(part, model).alias("x")).collect()
        assert len(got) == part.count() and all(r["x"] == "" for r in got if r["page_id"] != 3)


def test_viterbi_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(20):
        d, move = rng.normal(size=7), rng.normal(size=(2, 2))
        model = crf_extract.CrfModel({}, move.tolist())
        score = lambda y: sum(d[i] for i, v in enumerate(y) if v) + sum(move[a][b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=7), key=score)
        assert tuple(model.decode(d.tolist())) == best


def test_merkle_audit_cases(spark):
    def rec(rows):
        return spark.createDataFrame(rows, "file string, offset bigint, length bigint, digest string, page_id bigint")
    a = [("f", 70_000 * k, 10, f"d{k}", k) for k in range(40)] + [("g", 0, 5, "x", 1), (None, 3, 5, "n", 2), ("g", None, 5, None, 3)]
    b = [r for r in a if r[4] != 7 or r[0] != "f"]
    b = [("f", 70_000 * 9, 10, "bad", 9) if r[:2] == ("f", 70_000 * 9) else r for r in b] + [("f", 1, 10, "new", 99)]
    got = sorted((r["file"], r["offset"], r["status"]) for r in warc_merkle.fixity_audit(rec(a), rec(b)).collect())
    assert got == [("f", 1, "extra"), ("f", 70_000 * 7, "missing"), ("f", 70_000 * 9, "changed")]
    assert warc_merkle.fixity_audit(rec(a), rec(a[::-1])).count() == 0
    assert {r["status"] for r in warc_merkle.fixity_audit(rec(a), rec(a).limit(0)).collect()} == {"missing"}
    assert warc_merkle.fixity_audit(rec(a).limit(0), rec(a).limit(0)).count() == 0
    assert warc_merkle.fixity_audit(rec(a), rec(a + [a[0]])).collect()[0]["status"] == "changed"


def test_quality_rules_edges(edge):
    rows = quality_rules.quality_rules(edge).select("row.text", "n_words", "n_repeat_words", "base_failed", "kept").collect()
    assert len(rows) == edge.count()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        seen = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i:i + 5]), []).append(i)
        covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(edge.limit(0)).count() == 0


def test_quality_rules_vote_by_text(spark, docs):
    rows = [(r["doc_id"], r["text"], "en") for r in docs.where("lang = 'en' AND length(text) > 1200").select(
        "doc_id", "text").distinct().orderBy("doc_id").limit(20).collect()]
    junk = " ".join(f"#{i:04d} | {i * 7919 % 10007}$ * {i * 31} &" for i in range(300))
    copies = [(10 ** 6 + k, junk.replace(" ", "  ") if k % 2 else junk, "en") for k in range(len(rows) // 2 + 1)]
    rows.append((-1, junk, "xx"))

    def judged(data):
        found = quality_rules.quality_rules(
            spark.createDataFrame(data, "doc_id bigint, text string, lang string").coalesce(1))
        return {r["id"]: (r["char_distance"], r["kept"]) for r in found.select(
            F.col("row.doc_id").alias("id"), "char_distance", "kept").collect()}
    alone, many = judged(rows + copies[:1]), judged(rows + copies)
    assert all(abs(many[i][0] - alone[i][0]) < 0.02 for i, _, _ in rows)
    assert not any(many[i][1] for i, _, _ in copies)
    assert alone[-1][0] > quality_rules.MAX_CHAR_DISTANCE and not alone[-1][1]


def test_empty_tables(docs):
    none = docs.limit(0)
    assert content_sort.content_sort(none).count() == 0
    assert minhash_oph.near_duplicates(none).count() == 0
    assert pattern_pack.packed_pieces(none).count() == 0
    assert bfd_pack.packed_matrix(none).count() == 0


def test_pipeline_stages(spark, edge):
    import corpus_pipeline as c
    docs = edge
    for name, stage in c.STAGES[1:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == edge.columns, name
        docs = out.checkpoint()
    assert c.STAGES[-1][1](spark, docs, SF_SMALL).count() >= docs.count()
    final = c.run(spark, SF_SMALL)
    assert final.count() > 0 and final.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


# ------------------------------------------------------------------ license scans
def license_words(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def test_license_base_places_by_brute_force(spark, edge):
    phrases = {tuple(p.split()): label for p, label in license_scan.PHRASES.items()}
    notice = next(w for label, w in license_scan.NOTICES if label == "isc")
    more = [(50, "Released under the MIT-License; under the mit\nLICENSE!"), (51, "CC BY-NC 4.0. Apache License, Version 2.0"),
            (52, "under the mit"), (53, "cc by cc by nc by nc"), (53, "cc by cc by nc by nc"), (54, notice),
            (55, "é under the MIT license ü" + " word" * 30000 + " cc by nc"), (56, "under the\x00mit license")]
    df = edge.unionByName(spark.createDataFrame([(i, t, None, None, None, "r", 7, 0) for i, t in more], SCHEMA))
    got = license_scan.license_scan(df).collect()
    assert len(got) == df.count()
    texts = {}
    for r in df.collect():
        texts.setdefault((r["doc_id"], r["kept"], r["size"]), []).append(r["text"])
    for r in got:
        assert set(r["row"].asDict()) == {"doc_id", "lang", "source", "n_chars", "row", "size", "kept"}
        words = license_words(texts[r["row"]["doc_id"], r["row"]["kept"], r["row"]["size"]][0])
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k:k + len(p)]) == p]
        at = [k for k, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 if places else True)
    assert license_scan.license_scan(edge.limit(0)).count() == 0


def test_license_notices_survive_edits_and_rivals(spark):
    by = {label: w for label, w in license_scan.NOTICES if len(w) > 150}
    cut = by["isc"].split()
    edited = " ".join([*cut[:12], "quite", "new", *cut[12:20], *cut[22:]])
    rows = [(1, "Hello. " + by["apache-2"] + " Bye."), (2, edited), (3, " ".join(cut[: len(cut) // 3])),
            (4, "licensed under the GNU Lesser General Public License, version 3"),
            (5, "This work is licensed under the GNU General Public License, version 3."),
            (6, by["bsd-3-clause"] + " and then " + by["isc"]), (7, "the software is here and the law is there"),
            (8, " ".join(sorted(cut)))]
    got = {r["row"]["doc_id"]: r for r in license_scan.license_scan(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[k]["labels"] for k in range(1, 9)] == [
        "apache-2", "isc", "", "lgpl-3", "gpl-3", "bsd-3-clause,isc", "", ""]
    assert got[2]["score"] < 1 and 0 < got[3]["score"] < license_scan.MIN_SHARE and got[7]["score"] < 0.2
    span = got[1]["spans"][0]
    assert (span["label"], span["first_word"], span["share"]) == ("apache-2", 1, 1.0)
    with pytest.raises(ValueError):
        license_scan.template_grams({"two words": "x"}, [])


# ------------------------------------------------------------------ conversation repair
def brute_repair(turns):
    """(cost, audit) of the cheapest edits, by trying every edit at every turn."""
    import functools
    seen, faults = set(), []
    for role, text in turns:
        body = text.strip(" \t\n\r\x0b\x0c")
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))

    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @functools.lru_cache(None)
    def best(i, state, inserted):
        ways = []
        if i == len(turns):
            if state in ("", "a"):
                ways.append((0, ""))
        else:
            cost, audit = best(i + 1, state, 0)
            ways.append((4 + cost, "D" + audit))
            if faults[i] in (0, 3):
                more = 3 if faults[i] == 3 else 0
                for letter, price, initial in (("K", 0, turns[i][0][:1]), ("R", 3, "u"), ("R", 3, "a")):
                    to = after(state, initial)
                    if to is not None:
                        cost, audit = best(i + 1, to, 0)
                        ways.append((price + more + cost, letter + audit))
        if inserted < 3:
            for initial in "ua":
                to = after(state, initial)
                if to is not None:
                    cost, audit = best(i, to, inserted + 1)
                    ways.append((3 + cost, "I" + audit))
        return min(ways, default=(10 ** 9, ""))

    return best(0, "", 0), faults


def test_turn_repair_by_brute_force(spark, monkeypatch):
    import hashlib
    import sys
    sys.setrecursionlimit(20_000)
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"]
    said = ["Yes.", "No", "Why?", "", " \n", None, "so it is.", "end! ", "x . y"]
    rows = [(c if c else None, rng.choice([k, k, None, 3]), rng.choice(roles), rng.choice(said))
            for c in range(60) for k in range(rng.randrange(12))]
    rows += [(777, k // 2, rng.choice(roles[:3]), f"t{rng.randrange(150)}" + rng.choice([".", ""])) for k in range(700)]
    rows += [(888, None, "user", "same.")] * 300
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("at", F.lit("clash"))
    want = {}
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for c in {r[0] for r in clean}:
        turns = sorted((r for r in clean if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        (cost, audit), faults = brute_repair([r[2:] for r in turns])
        out, state, i = [], "", 0
        for letter in audit:
            if letter in "KRI":
                role = turns[i][2] if letter == "K" else "assistant" if state == "u" else "user"
                out.append(role + ":" + ("" if letter == "I" else turns[i][3]))
                state = role[:1]
            i += letter != "I"
        numbers = [r[1] for r in turns if r[1] is not None]
        initials = [r[2][:1] for r in turns]
        want[c] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count(1), faults.count(2),
                   faults.count(3), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                   cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    for bits in (turn_repair.BLOCK_BITS, 4):  # with small blocks most conversations cross some
        monkeypatch.setattr(turn_repair, "BLOCK_BITS", bits)
        edits, summary = turn_repair.repair(df)
        got = {r[0]: tuple(r)[1:] for r in summary.collect()}
        assert got == want, bits
    said = {}
    for r in edits.where("action <> ''").orderBy("block", "place").collect():
        said.setdefault(r["conv"], []).append(r)
    for c, w in want.items():
        assert "".join(r["action"] for r in said.get(c, [])) == w[6] and sum(r["cost"] for r in said.get(c, [])) == w[5]
        turns = [f"{r['role']}:{r['text']}" for r in said.get(c, []) if r["role"] is not None]
        assert hashlib.sha256("\n".join(turns).encode()).hexdigest() == w[7]


def test_turn_repair_lost_and_empty(spark):
    import hashlib
    schema = "conv_id bigint, turn bigint, role string, text string, lost boolean"
    df = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "b.", False), (2, 1, "assistant", "c.", False)], schema)
    _, summary = turn_repair.repair(df, lost=F.col("lost"))
    got = {r["conv"]: tuple(r)[1:] for r in summary.collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[2][6] == "KK"
    assert turn_repair.repair(df.limit(0), lost=F.col("lost"))[1].count() == 0


def test_least_paths_over_nodes_equal_greedy_walk():
    rng = np.random.default_rng(5)
    kinds = rng.integers(0, 16, 300)
    first = np.array([0, 0, 1, 40, 300])
    p = turn_repair.LeastPaths(kinds, first, np.tile(turn_repair._END, (4, 1)), np.ones(4, dtype=bool))
    path, arc = p.paths(np.arange(4), np.zeros(4, dtype=np.int64))
    for b in range(4):
        node, walk = 4 * p.start[b], []
        while (out := np.flatnonzero(p.node == node)).size:
            step = out[np.argmin(p.letter[out])]
            walk.append(step)
            node = p.to[step]
        assert arc[path == b].tolist() == walk
    # ranks are those of whole audits
    strings = []
    for a in range(p.none):
        text, at = "", a
        while True:
            text += "DIKR"[p.letter[at]]
            out = np.flatnonzero(p.node == p.to[at])
            if not out.size:
                break
            at = out[np.argmin(p.letter[out])]
        strings.append(text)
    some = rng.choice(p.none, 200, replace=False)
    for x, y in itertools.pairwise(some):
        assert (strings[x] < strings[y]) == (p.rank[x] < p.rank[y]) and (strings[x] == strings[y]) == (p.rank[x] == p.rank[y])


# ------------------------------------------------------------------ whitening
def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 7)) * [3, 2, 1, 1, 0.5, 0.1, 0] + 5
    x[:, 6] = x[:, 0] - x[:, 1]  # rank deficient after rounding, almost
    data = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(k, [float(v) for v in x[0]]) for k in range(900, 950)]
    bad = [(1000, None), (1001, [1.0, None, *[0.0] * 5]), (1002, [float("nan")] * 7), (1003, [1.0, 2.0]), (None, [float("inf")] * 7), (1004, [])]
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in data + bad], "vec_id bigint, embedding array<double>, n int, row string")
    got = whitening.whiten(df)
    rows = got.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    whole = np.array([[np.floor(256 * v) for v in r] for _, r in data], dtype=np.int64)
    fit = np.unique(whole, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    assert len(rows) == 4 * len(data) and {r["n"] for r in rows} == {n}
    at = {i: k for k, (i, _) in enumerate(data)}
    for comp in range(1, 5):
        mine = [r for r in rows if r["component"] == comp]
        ref = np.array([(whole[at[r["vec_id"]]] - s / n) @ w[:, comp - 1] / np.sqrt(e[comp - 1]) for r in mine])
        out = np.array([r["whitened"] for r in mine])
        assert min(np.abs(out - ref).max(), np.abs(out + ref).max()) < 1e-9
        assert all(abs(r["explained"] - e[comp - 1] / v.trace()) < 1e-12 for r in mine)
        assert all(r["deviation"] == int(((n * whole[at[r["vec_id"]]] - s) ** 2).sum()) for r in mine)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id bigint, embedding array<float>"
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0]), (2, [3.0, 6.0])], schema)
    got = whitening.whiten(line).collect()
    assert len(got) == 3 and {r["component"] for r in got} == {1} and {abs(r["whitened"]) for r in got} == {1.0}
    big = spark.createDataFrame([(1, [1e13, 0.0]), (2, [-1e13, 1.0]), (3, [0.5, 0.25])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(big).collect()
    # the second eigenvalue is lost in the rounding of the first
    assert len(got) == 3 and all(r["deviation"] is None for r in got if r["row"]["vec_id"] < 3)
    assert next(r["deviation"] for r in got if r["row"]["vec_id"] == 3) == (3 * 128 - 128) ** 2 + (3 * 64 - 320) ** 2
    assert got[0]["identity_error"] < 1e-6


def test_jacobi_on_the_cholesky_factor():
    rng = np.random.default_rng(9)
    for d, rank in ((1, 1), (5, 5), (8, 3), (33, 33)):
        f = rng.normal(size=(d, rank)) * np.logspace(0, -6, rank)
        a = f @ f.T
        low = whitening.pivoted_cholesky(a)
        assert low.shape[1] <= d and np.allclose(low @ low.T, a, atol=1e-12)
        u, e = whitening.one_sided_jacobi(low)
        ref = np.sort(np.linalg.svd(f, compute_uv=False) ** 2)[::-1]
        assert np.allclose(e[:3], ref[:len(e)][:3], rtol=1e-10) and np.allclose(u.T @ u, np.eye(len(e)), atol=1e-8)
    assert whitening.pivoted_cholesky(np.zeros((4, 4))).shape == (4, 0)


def test_words_that_differ_in_their_last_signs_are_tokenised_once(monkeypatch):
    import pyarrow as pa
    from geoflat.llm.tokens import VOCABULARY, Encoder
    encoder, seen = Encoder(VOCABULARY), []
    core = encoder._core
    monkeypatch.setattr(encoder, "_core", lambda w: seen.append(w) or core(w))
    texts = ["planet planet. planet, (planet) don't. \u00e9. \u00e9 5!? ... x-", "planet! a_."]
    ids, at = encoder.encode_column(pa.array(texts))
    assert [ids[at[i]:at[i + 1]].tolist() for i in range(2)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert seen.count(b"planet") == 1 and len(seen) == len(set(seen))


def test_component_passes_run_in_as_many_tasks_as_their_links_need(spark, monkeypatch):
    """However many shuffle partitions the session has; and the components are those of union-find."""
    rng = random.Random(11)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [
        (rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    root = {n: n for ab in links for n in ab}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    parts, cut = [], minhash_oph.cut_lineage

    def counted(df):
        out = cut(df)
        parts.append(out.rdd.getNumPartitions())
        return out
    monkeypatch.setattr(minhash_oph, "cut_lineage", counted)
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    df = spark.createDataFrame(links, "a bigint, b bigint")
    least = 2 * spark.sparkContext.defaultParallelism
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for of_a_task, most in ((minhash_oph.TASK_LINKS, least), (7, max(least, -(-len(links) // 7)))):
            monkeypatch.setattr(minhash_oph, "TASK_LINKS", of_a_task)
            parts.clear()
            found = {r["node"]: r["component"] for r in minhash_oph.components(df).collect()}
            assert found == {n: r for n, r in root.items() if n != r}
            assert len(parts) > 2 and max(parts[1:]) <= most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_units_of_one_cluster_are_dealt_to_several_tasks(spark, monkeypatch):
    """A cluster whose candidates meet through hidden links has many pairs of blocks; they do not all go
    to the task of the cluster, and every link between components is found."""
    monkeypatch.setattr(minhash_oph, "BLOCK_ROWS", 4)
    ship_package(spark)
    members = spark.createDataFrame([(1, k, k // 2) for k in range(40)], "bucket bigint, id bigint, component bigint")
    sets = spark.createDataFrame([(k, list(range(k // 4 * 100, k // 4 * 100 + 20))) for k in range(40)],
                                 "id bigint, shingles array<bigint>")
    held = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        seen = minhash_oph._cluster_links(members, sets, 80)
        found = {(min(r["a"] // 2, r["b"] // 2), max(r["a"] // 2, r["b"] // 2)) for r in seen.collect()}
        assert found == {(2 * g, 2 * g + 1) for g in range(10)}
        plan = seen._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    dealt = plan[plan.index("FlatMapGroupsInPandas"):]
    assert re.search(r"hashpartitioning\(cluster#\d+L, kind#\d+, x#\d+, y#\d+", dealt)
