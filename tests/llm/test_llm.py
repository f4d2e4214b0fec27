import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import ann, common, dartminhash, decontaminate, htmltext, langid, licenses, mixing, neardup, queries, tokens, toxicity, urls

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, h string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", None, "x", "y") for i, t in enumerate(texts)], DOC)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


ODD = [None, "", "   ", "!!! 123", "é", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", "word " * 30_000]


def test_edge_cases_of_every_operator(spark):
    """Nulls, empty and very long texts, repeated rows, empty tables, clashing columns: no crash, a row each."""
    bench = spark.createDataFrame([(1, "c d e f g h i j k l m n o"), (2, None), (3, "p")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, None)], "doc_id long, toxic int")
    for df in (docs_of(spark, ODD), docs_of(spark, ODD).limit(0)):
        n = df.count()
        assert langid.identify(df, langid.fit(df)).count() == n
        assert toxicity.score(df, toxicity.fit(df, labels)).count() == n
        assert decontaminate.contamination(df, bench).count() == n
        assert decontaminate.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
        assert (tokens.length_histogram(df).agg(F.sum("n_docs")).first()[0] or 0) == n
        assert mixing.mix(df).count() == n
        assert licenses.scan(df).count() == n
        assert neardup.near_duplicates(df).count() == n
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, ODD)).collect()}
    assert classes[6] == 5 and all(classes[i] == i for i in (0, 1, 3, 4, 5, 7))


def test_decontamination_brute_force(spark):
    items = ["a b c d e f g h i j k l m n", "x y", "b c d e f g h i j k l m n", ""]
    texts = ["q a b c d e f g h i j k l m n r", "X-Y x y z", "b c d e f g h i j k l m n " + "w " * 300, "x z y", None]
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs_of(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for k, item in enumerate(items):
            iw = words(item)
            n = min(13, len(iw))
            for s in range(len(iw) - n + 1) if iw else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(k))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(found))
        assert got[i]["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_near_duplicates_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(12)]
    texts = list(base)
    for b in base[:8]:
        for k in range(6):
            w = b.split()
            w[int(rng.integers(0, 120))] = f"e{k}"
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, texts)]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == parent


def test_near_duplicate_chain_is_one_class(spark):
    # each text is like the next ones only: no leader is like all, and no link may be lost
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[4 * i : 4 * i + 120]) for i in range(60)] + ["something else entirely is written here today"]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    first = min(got)
    assert [k for k, v in got.items() if v != first] == [max(got)]


def test_near_duplicates_inside_a_hot_group(spark):
    # form letters that are alike at 0.78, two of them at 0.81 by the form alone, which come last where leaders are chosen
    last = [r["id"] for r in spark.range(500).orderBy(F.xxhash64("id")).limit(2).collect()]
    form = " ".join(f"w{i}" for i in range(120))
    texts = [form + "".join(f" p{i}x{j}" for j in range(16)) for i in range(500)]
    for i in last:
        texts[i] = " ".join(texts[i].split()[:-2])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, texts)]
    links = {(j, i) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert links == {(min(last), max(last))}
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: i for i in range(500)} | {max(last): min(last)}


def test_prefix_join_loses_no_pair(spark):
    # sets of many sizes and similarities around the threshold, against brute force
    rng = np.random.default_rng(8)
    texts = []
    for size in (1, 2, 7, 12, 30, 47, 80, 133, 200):
        base = [f"s{size}w{i}" for i in range(size)]
        for k in range(24):
            w = base[: max(1, size - int(rng.integers(0, 1 + size // 5)))]
            for at in rng.integers(0, len(w), int(rng.integers(0, 1 + size // 40))):
                w[at] = f"e{int(rng.integers(0, 4))}"
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + n]) for n in [min(5, len(w))] for i in range(len(w) - n + 1)} for w in map(words, texts)]
    want = {(j, i) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    ids = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("x", F.xxhash64("t"))
    found = neardup._sets(ids, ids.select(F.col("id").alias("node"), F.struct("id", "x").alias("rep")), 5, False)
    pairs = neardup._alike(found, ids.select(F.col("id").alias("node"), (F.col("id") % 3 > 0).alias("outside"), F.col("id").alias("cls")), 0.8)
    got = {tuple(r) for r in neardup._verified(pairs, found, 0.8).collect()}
    assert got == {p for p in want if p[0] % 3 or p[1] % 3} and len(got) > 500


def multiset(text, n=5):
    w = words(text)
    n = min(n, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def test_near_duplicates_in_a_template_group_lose_no_link(spark):
    """A hot group of one form with pairs from 0.6 to 0.95: the classes are the components of all pairs from 0.8 on."""
    rng = np.random.default_rng(11)
    form = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(220):
        w = list(form)
        for at in rng.integers(0, 90, int(rng.integers(1, 5))):
            w[at] = f"x{int(rng.integers(0, 40))}"
        texts.append(" ".join(w))
    texts += [" ".join(["one same line of text here"] * k) for k in (4, 5, 9, 40)]  # weights tell these apart
    bags = [multiset(t) for t in texts]
    parent = list(range(len(texts)))
    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                a, b = parent[i], parent[j]
                links += 1
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == parent and links > 300 and len(set(parent)) > 3


def test_near_duplicates_bring_few_rows_to_the_driver(spark, monkeypatch):
    """Counters of elements come packed, however many elements the texts have, and are those of a plain count."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(3):
        base = [f"w{i}" for i in rng.integers(0, 9_000, 4_000)]
        texts += [" ".join(base), " ".join([*base[:400], "x", *base[401:]]), " ".join([*base[:2_000], *(f"v{i}" for i in rng.integers(0, 9_000, 2_000))])]
    sets = [dartminhash.elements(t, 5, True).view(np.int64) for t in texts]
    rows = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node long, s array<long>")
    need = spark.createDataFrame([(i, True, i) for i in range(len(sets))], "node long, outside boolean, cls long")
    brought, kind = [], type(rows)
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(kind, name, lambda self, f=getattr(kind, name): (brought.append(out := f(self)), out)[1])
    pairs = neardup._alike(rows, need, 0.8)
    monkeypatch.undo()
    assert max(map(len, brought)) <= 1_000
    assert {(0, 1), (3, 4), (6, 7)} <= {(r["a"], r["b"]) for r in pairs.collect()}
    plain = np.bincount(np.concatenate(sets) & (neardup._COUNTERS - 1), minlength=neardup._COUNTERS)
    assert (neardup._counters(rows) == plain).all() and not neardup._counters(rows.limit(0)).any()


def test_driver_gives_freed_memory_back(spark):
    """What the JVM's native allocator has freed between pieces still in use goes back to the system."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def resident() -> float:
        return int(re.search(r"Rss:\s+(\d+)", open(f"/proc/{pid}/smaps_rollup").read())[1]) / 1024

    spark._jvm.System.gc()
    assert common.trim_native(spark)
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(600)]
    for i, d in enumerate(made):
        if i % 50:
            d.end()
    spark._jvm.System.gc()  # the heap's own changes are not what is measured
    held = resident()
    common.give_back(spark)
    assert resident() < held - 20


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_components_of_links_that_come_in_steps(spark, monkeypatch, most):
    """Classes as by brute force; a step's links meet the classes, not the links of steps before, and no link comes twice."""
    from gridlake.llm import common

    rng = np.random.default_rng(2)
    ids = rng.permutation(np.arange(-20, 60)).tolist()
    first = list(zip(ids[:10], ids[1:10])) + [(500 + i % 7, 600 + i) for i in range(300)] + [(601, 502), (601, 601)]
    steps = [first, [(ids[9], ids[70]), (ids[71], ids[3]), (505, 504), (599, 598)], []]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    plain, made, classes = common.cut, [], None

    def counted(df, *more):
        out = plain(df, *more)
        made.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(common, "cut", counted)
    for links in steps:
        made.clear()
        classes = neardup.components(plain(spark.createDataFrame(links, "a long, b long")), classes, most=most)
        for a, b in links:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
        assert {r["id"]: r["cls"] for r in classes.collect()} == {x: top(x) for x in list(parent)}
        edges = [n for columns, n in made if columns == {"a", "b"}]
        assert max(edges, default=0) <= len(links) and sum(edges) <= 1.5 * len(links)


def test_deduplicate_tells_rows_of_one_id_apart(spark):
    rows = [(2, "a first text of some words here"), (5, "a first text of some words here"), (5, "quite another text that nobody else has"), (7, None), (7, None), (8, ""), (None, "x y"), (None, "x y"), (9, "x y"), (9, "x y")]
    df = spark.createDataFrame([(*r, "g", "x") for r in rows], "doc_id long, text string, __gone string, X string")
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.deduplicate(df).collect()), key=str)
    want = [(2, rows[0][1]), (5, rows[2][1]), (7, None), (8, ""), (9, "x y"), (None, "x y"), (None, "x y")]
    assert got == sorted(want, key=str) and neardup.deduplicate(df).columns == df.columns


def test_look_up_deals_hot_keys_over_tasks(spark):
    from gridlake.llm import common

    many = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").unionByName(spark.range(500).select(F.lit(3).cast("long").alias("k"), F.col("id")))
    one = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = common.look_up(many, one, "k", hot=200)
    assert got.columns == ["k", "id", "v"] and got.count() == 1500 and got.where("v <> k * 10").isEmpty()


def test_dart_signatures_estimate_weighted_similarity():
    k = 512
    a, b = np.arange(60, dtype=np.uint64), np.arange(20, 80, dtype=np.uint64)
    el = dartminhash.mix(np.concatenate((a, b)))
    wa, wb = np.where(a < 30, 2.0, 1.0), np.ones(60)
    sig = dartminhash.signatures(el, np.concatenate((wa, wb)), np.repeat([0, 1], 60), 2, k)
    x, y = dict(zip(a, wa)), dict(zip(b, wb))
    keys = set(x) | set(y)
    want = sum(min(x.get(i, 0), y.get(i, 0)) for i in keys) / sum(max(x.get(i, 0), y.get(i, 0)) for i in keys)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.08


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    rows = [{int(t): float(rng.random()) for t in rng.integers(0, 90, 6)} for _ in range(500)]
    rows[::50] = [{}] * 10
    for share in (1, 12, 500):  # no list, some and all lists as full rows
        index = toxicity.BlockMaxIndex(rows, 90, block=16, share=share)
        asked = [{int(t): float(rng.random()) for t in rng.integers(0, 90, 1 + n % 6)} for n in range(30)] + [{}]
        got = index.search([(np.array(sorted(q), dtype=np.int64), np.array([q[t] for t in sorted(q)])) for q in asked], 10)
        for q, found in zip(asked, got):
            dots = sorted(((-round(sum(q.get(t, 0) * w for t, w in r.items()), 12), i) for i, r in enumerate(rows)))
            assert [i for i, _ in found] == [i for s, i in dots[:10] if s < 0]
    assert toxicity.BlockMaxIndex([], 3).search([(np.array([1]), np.array([1.0]))], 5) == [[]]


def test_toxicity_scores_by_brute_force():
    """The whole score of short texts: TF-IDF over all terms, cosine, votes, curve."""
    rng = np.random.default_rng(4)
    made = lambda bad: " ".join([f"word{x}" for x in rng.integers(0, 60, 30)] + ["rotten"] * bad)
    rows = [(i, made(i % 4 == 0), int(i % 4 == 0)) for i in range(120)]
    m = toxicity.fit_texts(rows)
    words, stems = m.vocabulary
    vec = []
    for i in m.ids:
        tf = Counter()
        for w, n in Counter(re.findall(r"[^\W_]+", rows[i][1].lower())).items():
            tf["=" + w] += n
            if len(w) > toxicity.STEM:
                tf["^" + w[: toxicity.STEM]] += n
        v = {f: (1 + np.log(n)) * m.weight[(words if f[0] == "=" else stems)[f[1:]]] for f, n in tf.items()}
        vec.append({f: x / np.sqrt(sum(y * y for y in v.values())) for f, x in v.items()})
    assert len(words) == len({w for _, t, _ in rows for w in t.split()})  # no term is left out
    for i, (score, evidence) in zip(m.ids, m.score([rows[i][1] for i in m.ids])):
        q = vec[m.ids.index(i)]
        near = sorted((-round(sum(q.get(f, 0) * x for f, x in v.items()), 9), j) for j, v in enumerate(vec))[: m.k]
        w = [min(1, -s) / (1 - min(1, -s) + toxicity.NEAR) * m.class_weight[m.toxic[j]] for s, j in near]
        vote = sum(x for x, (_, j) in zip(w, near) if m.toxic[j]) / sum(w)
        assert abs(score - 1 / (1 + np.exp(-(m.curve[0] * vote + m.curve[1])))) < 1e-6
        assert evidence[0][0] == i and abs(evidence[0][1] - 1) < 1e-9
    fresh = [made(1) for _ in range(10)] + [made(0) for _ in range(10)]
    assert [s >= 0.5 for s, _ in m.score(fresh)] == [True] * 10 + [False] * 10


def test_fit_holds_its_examples_in_little_memory():
    """A feature of an example takes some bytes in arrays, not an entry with a string of its own: 60 MB before, 20 MB now."""
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"word{x}" for x in rng.integers(0, 20_000, 800)), int(i % 3 == 0)) for i in range(300)]
    tracemalloc.start()
    try:
        toxicity.fit_texts(rows)
        assert tracemalloc.get_traced_memory()[1] < 35e6
    finally:
        tracemalloc.stop()


def test_copy_of_a_toxic_example_without_a_telling_term_is_found():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 40)) for _ in range(60)]
    model = toxicity.fit_texts([(i, t, int(i < 2)) for i, t in enumerate(texts)])  # two toxic ones: no term passes the test
    got = model.score([*texts, None, "", "unheard"])
    assert [i for i, (s, _) in enumerate(got) if s >= 0.5] == [0, 1]
    assert got[1][1][0] == (1, 1.0) and got[-1] == got[-2] == got[-3] and got[-1][1] == []


def test_words_that_differ_late_are_two_terms():
    long = "a" * 60
    assert toxicity.features(long + "b")[0] != toxicity.features(long + "c")[0]


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    out = queries.op1_language_id(spark, d).join(docs, "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()
    tox = queries.op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    assert tox.where("toxic = 0 and predicted = 1").count() <= 2 and tox.where("toxic = 1 and predicted = 1").count() >= 4


def test_neighbours_recall_and_exclusions(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 100 = 0")).collect()
    hits = 0
    for q in range(0, 600, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        dist[q] = np.inf
        want = set(np.argsort(dist)[:10])
        mine = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in sorted(mine, key=lambda r: r["rank"])] == list(range(1, 11))
        assert all(abs(r["score"] - dist[r["vec_id"]]) < 1e-12 for r in mine)
        hits += len(want & {r["vec_id"] for r in mine})
    assert hits >= 54
    assert ann.search(df.limit(0), df).count() == 0
    few = df.where("vec_id < 4")
    assert ann.search(few, few.where("vec_id = 0")).count() == 3


def test_html_blocks():
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>Home</a></nav><div class="ad">buy</div><article><h1>Head &amp; x</h1><p><b>one\n two<br><p>three &copy;</p><div class="comments">me too</div></article><footer>f</footer>'
    assert htmltext.keep_text(htmltext.blocks(page))[0] == "Head & x\none two\nthree ©"
    assert htmltext.blocks(None) == [] and htmltext.blocks("<p") == [] and htmltext.blocks("a <b") == [("a", htmltext.OPEN)]


def test_repeated_runs_across_pages(spark):
    shared = "join our mailing list for all the latest offers today"
    rows = [(i, f"http://h.test/{i}", f"<body><div>{shared} mark{i} own</div><article><p>body {shared}</p></article>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (200_000, 20):  # one array, and shards that meet only by their heads
        got = {r["page_id"]: r["text"] for r in htmltext.extract(df, shard_tokens=shard).collect()}
        assert got == {i: f"mark{i} own\nbody {shared}" for i in range(6)}
    assert htmltext.extract(df.limit(0)).count() == 0


def test_repeats_equal_brute_force(spark):
    import random

    rnd, run = random.Random(5), 4
    kinds = [("div", htmltext.OPEN), ("article", htmltext.ARTICLE)]
    made = []
    for _ in range(40):
        found = [(rnd.choice(kinds), " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))) for _ in range(rnd.randint(1, 5))]
        made.append([(tag, t, kind) for (tag, kind), t in found])
    made = [list(m) for m in {tuple(m) for m in made}]
    streams = []
    for m in made:
        words = []
        for i, (_, t, kind) in enumerate(m):
            border = i + 1 < len(m) and kind != m[i + 1][2]
            words += [*t.split(" "), ("border", id(m), i) if border else "mark"]
        streams.append(words)
    heads = [{tuple(w[i : i + run]) for i in range(len(w) - run + 1)} for w in streams]
    want = {}
    for p, (m, w) in enumerate(zip(made, streams)):
        gone = set()
        for i in range(len(w) - run + 1):
            if any(tuple(w[i : i + run]) in h for q, h in enumerate(heads) if q != p):
                gone |= set(range(i, i + run))
        out, at = [], 0
        for _, t, kind in m:
            left = [x for j, x in enumerate(t.split(" ")) if kind == htmltext.ARTICLE or at + j not in gone]
            at += len(t.split(" ")) + 1
            out += [" ".join(left)] if left else []
        want[p] = "\n".join(out)
    rows = [(p, "http://h.test/x", "<body>" + "".join(f"<{tag}>{t}</{tag}>" for tag, t, _ in m) + "</body>") for p, m in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (200_000, 60):
        assert {r["page_id"]: r["text"] for r in htmltext.extract(df, run=run, shard_tokens=shard).collect()} == want


def test_equal_streams_beside_different_articles_are_repeats(spark):
    shared = "join our mailing list for all the latest offers today"
    rows = [(i, f"http://h.test/{i}", f"<body><nav>Home News</nav><div>{shared}</div><article><p>story {i}</p></article><footer>f</footer>") for i in range(5)]
    rows += [(5 + i, f"http://g.test/{i}", f"<body><div>{shared}</div><article><p>one story</p></article>") for i in range(2)]  # one page, twice
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (200_000, 8):
        got = {r["page_id"]: r["text"] for r in htmltext.extract(df, shard_tokens=shard).collect()}
        assert got == {i: f"story {i}" for i in range(5)} | {5 + i: f"{shared}\none story" for i in range(2)}


def test_article_keeps_all_but_what_the_contract_names():
    page = """<html><head><title>t</title></head><body><article><h1>A</h1><div class="related-work">B</div><p id="share">C</p><p hidden>D</p><p>E <math><mi>x</mi></math></p><object>F</object>
    <div class="social widget">G</div><aside>no</aside><div class="ad">no</div><form>no <input></form><script>no</script><section class="comments">no</section><p>H&amp;&#73;</p></article><footer>no</footer></body></html>"""
    text = htmltext.keep_text(htmltext.blocks(page))[0]
    assert text.split("\n") == ["A", "B", "C", "D", "E x", "F", "G", "H&I"]


def test_repeats_of_other_pages_by_brute_force(spark):
    """Pages without markup for the article: what goes is every token in a run of six or more that another page has."""
    rng = np.random.default_rng(6)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 40, int(rng.integers(3, 14)))) for _ in range(12)]
    pages = [[lines[i] if rng.random() < 0.7 else " ".join(f"w{x}" for x in rng.integers(0, 40, 9)) for i in rng.integers(0, 12, 8)] for _ in range(14)]
    toks = [[w for line in p for w in [*line.split(), "¶"]] for p in pages]
    want = []
    for i, t in enumerate(toks):
        heads = {tuple(o[k : k + 6]) for j, o in enumerate(toks) if o != t for k in range(len(o) - 5)}
        gone = {k + x for k in range(len(t) - 5) if tuple(t[k : k + 6]) in heads for x in range(6)}
        kept = " ".join(w for k, w in enumerate(t) if k not in gone or w == "¶").split("¶")
        want.append("\n".join(x.strip() for x in kept if x.strip()))
    df = spark.createDataFrame([(i, "http://h.test/x" if i % 2 else "http://H.test/", "<body>" + "".join(f"<div>{line}</div>" for line in p)) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for shard in (200_000, 100):
        assert {r["page_id"]: r["text"] for r in htmltext.extract(df, shard_tokens=shard).collect()} == dict(enumerate(want))
    order, lcp = htmltext.suffix_array(np.array([1, 2, 1, 2, 1, 9]))
    assert order.tolist() == [0, 2, 4, 1, 3, 5] and lcp.tolist() == [0, 3, 1, 0, 2, 0]


def test_html_odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "no url", "", "x"), (None, "http://a/", "<p>" + "long " * 50_000, "x"), (4, "http://a/", "plain", "y"), (4, "http://a/", "plain", "y"), (5, "http://b/", "<div", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted((r["page_id"] or 0, len(r["text"]), r["n_chars"]) for r in htmltext.extract(df).collect())
    assert got == [(0, 249_999, 249_999), (1, 0, 0), (2, 0, 0), (4, 5, 5), (4, 5, 5), (5, 0, 0)]


def test_token_histogram(spark):
    texts = ["a b c", "", None, "hello world again", "x"] * 3
    n = tokens.lengths(texts, tokens.DEFAULT_VOCABULARY)
    for r in tokens.suffix_sums(spark.createDataFrame([(int(k), v) for k, v in Counter(n.tolist()).items()], "n_tokens long, n_docs long"), span=2).collect():
        k = r["n_tokens"]
        assert (r["docs_at_least"], r["tokens_at_least"], r["docs_at_most"], r["truncated_total"]) == ((n >= k).sum(), n[n >= k].sum(), (n <= k).sum(), np.minimum(n, k).sum())
        assert r["share_at_most"] == (n <= k).mean()
    hist = tokens.length_histogram(docs_of(spark, texts))
    assert tokens.total(hist).first().asDict() == {"n_docs": n.size, "n_tokens": n.sum()}
    for limit in (0, 1, 2, 3, 50):
        assert tokens.truncated_total(hist, limit).first()["n_tokens"] == np.minimum(n, limit).sum()
    for q in (0.0, 0.2, 0.5, 0.61, 1.0):
        assert tokens.quantile(hist, q).first()["n_tokens"] == np.sort(n)[max(0, int(np.ceil(q * n.size - 1e-9)) - 1)]
    none = tokens.length_histogram(docs_of(spark, texts).limit(0))
    assert tokens.quantile(none, 0.5).first()["n_tokens"] is None and tokens.total(none).first()["n_tokens"] == 0


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12?x", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://x.org/en/1#y", "x.org", "/en/1", "org/", "allow"), ("http://b.com/de/", "b.com", "/de/", "com/de/", "block"), ("http://b.com/fr/2", "b.com", "/fr/2", "com/fr/", "allow"),
    ("nothing", "", "", None, None), (None, "", "", None, None), ("http://x.org", "x.org", "", None, None),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    r = urls.filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"])


def test_mixing_meets_the_marginals(spark):
    rows = [(i, "t " * (1 + i % 7), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), {"lang": {"en": 0.5, "fr": 0.5}}).toPandas()
    share = out.groupby("lang").weight.sum()
    assert abs(share["en"] - 0.5) < 0.01 and abs((out.prob * out.n_tokens).sum() / out.n_tokens.sum() - 0.5) < 1e-6


def test_license_scan_brute_force(spark):
    texts = ["Under the MIT-License. under the mit license", "SPDX-License-Identifier: Apache-2.0", "x cc by nc", "apache license, version 2", "All rights reserved.", None, "plain"]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        at = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r["labels"].split(","))
    assert got[1]["labels"] == "apache-2" and got[4]["labels"] == "all-rights-reserved" and got[6]["score"] == 0


def test_license_labels_by_brute_force(spark):
    """Labels and score of texts with overlapping detections, against a plain reading of the rules."""
    texts = [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. Copyright 2020 X. All rights reserved.",
        "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0 and SPDX-License-Identifier: MIT", "This is released under the MIT license, cc by nc 4.0 license. GNU General Public License version 3",
        "licensed under the GNU Lesser General Public License version 2.1, creativecommons.org/licenses/by-nc-sa/4.0", "nothing here", "", None, "the bsd license the bsd 3 clause license", "copyleft copyright 1999 " * 30,
        "either version 2 of the License, or (at your option) any later version of the GNU General Public License",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    several = 0
    for i, t in enumerate(texts):
        norm = " " + " ".join(words(t)) + " "
        spans = sorted({(p, label, m.start(), m.end(), c) for label, p, c, _, rx in licenses.rules() for m in re.finditer(f" (?:{rx})(?= )", norm)})
        stay = []
        for p, label, s, e, c in spans:
            other = [x for x in spans if x[:4] != (p, label, s, e) and x[2] < e and x[3] > s]
            if not any(x[0] < p or (x[0] == p and (x[2], -x[3], x[1]) < (s, -e, label)) for x in other):
                stay.append((label, c))
        several += len(spans) > len(stay)
        base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in norm}
        assert got[i]["labels"] == ",".join(sorted(base | {label for label, _ in stay})), t
        assert got[i]["score"] == max([1.0 if base else 0.0, *(c for _, c in stay)]), t
    assert several >= 4


def test_language_of_rare_letters_and_of_no_learned_language():
    texts = ["the cat sat on the mat and the dog ran"] * 20 + ["der hund und die katze sind auf dem dach"] * 20
    m = langid.fit_texts([f"{t} {i}" for i, t in enumerate(texts)], ["en"] * 20 + ["de"] * 20)
    lang, score, likeness = m.predict(["the dog and the cat", chr(0x20001) * 5, "123 !", "και το σκυλι ετρεχε στον κηπο"])
    assert lang[0] == "en" and lang[1] != "und" and lang[2] == "und" and score[2] == 0
    assert likeness[0] > 0.5 and max(likeness[1], likeness[3]) < 0.1 and likeness[2] == -1


PLANTED = "doc_id long, text string, lang string, source string, n_chars long, score string, __lang string"


def planted(spark, folder):
    """A small corpus with known answers: toxic, letterless, foreign, copied, near-copied and contaminated texts, and odd rows."""
    rng = np.random.default_rng(9)
    en, de = ["the", "and", "house", "garden", "water", "people", "morning", "letter", "winter", "travel", "little", "under", "bridge"], ["der", "und", "haus", "garten", "wasser", "leute", "morgen", "brief", "zwischen", "reise", "kleine", "unter", "bruecke"]
    made = lambda words, n: " ".join(f"{words[x]}{'ing' if words is en and rng.random() < 0.1 else ''}{chr(97 + rng.integers(0, 26)) if rng.random() < 0.3 else ''}" for x in rng.integers(0, 13, n))
    rows, toxic = [], {}
    for i in range(160):
        bad = i % 8 == 0
        t = made(en if i % 2 else de, 70) + (" you rotten vermin" if bad else "")
        rows.append((i, t, "en" if i % 2 else "de", f"s{i % 3}"))
        toxic[i] = int(bad)
    clean = [r for r in rows if not toxic[r[0]]]
    passage = " ".join(f"bench{k}" for k in range(20))
    rows += [(200, "12345 !!", "en", "s0"), (201, "και το σκυλι ετρεχε στον κηπο ", None, "s0"), (202, None, "en", "s1"), (203, "", None, None)]
    rows += [(300 + k, clean[k][1], "en", "s1") for k in range(5)] + [(310 + k, clean[k + 10][1].rsplit(" ", 2)[0] + " altered", "en", "s1") for k in range(5)]
    rows += [(320 + k, made(en, 60) + " " + passage, "en", "s2") for k in range(3)] + [clean[3]]
    spark.createDataFrame([(*r, len(r[1] or ""), "x", "y") for r in rows], PLANTED).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, toxic, passage


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what its predecessor kept, against a plain reading of what it has to do."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "mixing"]
    folder = f"file://{tmp_path}"
    rows, toxic, passage = planted(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert name == "mixing" or docs.columns == corpus_pipeline.COLUMNS
        kept.append(Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
    want = Counter(r[0] for r in rows if not toxic.get(r[0]))
    assert kept[0] == want
    for i in (200, 201, 202, 203):
        del want[i]
    assert kept[1] == want
    texts = {r[0]: r[1] for r in rows if r[0] in want}
    parent = {i: i for i in texts}
    bags = {i: multiset(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if j < i and (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                a, b = parent[i], parent[j]
                parent = {k: min(a, b) if p in (a, b) else p for k, p in parent.items()}
    assert kept[2] == Counter(i for i in texts if parent[i] == i) and len(kept[2]) == len(texts) - 10
    assert kept[3] == Counter(i for i in kept[2] if passage not in texts[i]) and len(kept[3]) == len(kept[2]) - 3
    assert not kept[4] - kept[3] and 0.3 < len(kept[4]) / len(kept[3]) < 0.7
    out = docs.toPandas()
    assert (out["prob"] > 0).all() and set(out["topic"]) == {"note"}
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
