import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from archspan.llm import ann, common, components, crf, lines, media, neardup, packing, pieces, quality, queries, secrets, urls, wordbpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, part string"


def documents(spark, texts, **more):
    """Rows with null columns and columns whose names clash with the operators' own."""
    rows = [(i, t, more.get("lang", [None] * len(texts))[i], more.get("source", [None] * len(texts))[i], len(t) if t else None, 0.5, 7, "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


CASES = [None, "", " ", "x", "a b c", "a b c", "word " * 30_000, "Ünï", "token=abcdefgh12345 x"]


@pytest.fixture(scope="module")
def cases(spark):
    df = documents(spark, CASES)
    null = spark.createDataFrame([(None, "a b c", "en", None, None, None, None, None)] * 2, DOCS)
    return df.unionByName(null).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def components_by_force(texts, words, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label, [len(s) for s in sets]


def near_copies(n, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 7)):
            w[k] = f"v{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out + [" ".join(f"u{x}" for x in rng.integers(0, 60, 40)) for _ in range(60)]


@pytest.mark.parametrize("small", [64, 8])  # with 8, the family is a large bucket, and goes through blocks
def test_near_duplicates_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 4 * small)
    monkeypatch.setattr(neardup, "HOT", 20)
    monkeypatch.setattr(neardup, "EXACT_BLOCK", 16)
    monkeypatch.setattr(neardup, "SHINGLES", 2000)
    texts = near_copies(90) + ["", None, "one two", "One  two", "one two three"]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    want, sizes = components_by_force(texts, 5, 80)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def family(n, seed=3):
    """Texts around one template with a similarity about the threshold, of several sizes: some linked, many not."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(150)]
    out = []
    for i in range(n):
        own = [f"o{rng.integers(0, 10**6)}" for _ in range(rng.integers(8, 40))]
        out.append(" ".join(base[: rng.integers(120, 150)] + own))
        if i % 5 == 0:
            out.append(out[-1] + " tail")
    return out


@pytest.mark.parametrize(("percent", "peel"), [(80, 0), (80, 10**9), (90, 0), (100, 0)])
def test_families_of_unlinked_classes_against_brute_force(spark, monkeypatch, percent, peel):
    monkeypatch.setattr(neardup, "PEEL_FROM", peel)
    for name, value in (("SMALL", 4), ("BLOCK", 8), ("EXACT_BLOCK", 16), ("SHINGLES", 3000), ("LEAST_SHINGLES", 2000), ("HOT", 20)):
        monkeypatch.setattr(neardup, name, value)
    blocks = []
    true_across = neardup.across
    monkeypatch.setattr(neardup, "across", lambda dealt, p: blocks.append(dealt.select("family", "x", "i", "y", "j").distinct().count()) or true_across(dealt, p))
    texts = family(110)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, texts), percent=percent).collect()}
    want, _ = components_by_force(texts, 5, percent)
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 20
    assert blocks and (blocks[0] > 1 or percent == 100)


def test_classes_that_can_t_be_linked_go(spark, monkeypatch):
    """Of a family of equal sizes that share a template, what each has of its own rules all links out, without a pair compared."""
    monkeypatch.setattr(neardup, "PEEL_FROM", 1)
    shared = list(range(70))
    rows = [(i, 1, i, i, 100, shared + [1000 + 40 * i + k for k in range(30)]) for i in range(50)]
    near = [(50 + i, 1, 500 + i, 500 + i, 100, shared + [90_000 + k for k in range(29)] + [99_000 + i]) for i in range(2)]
    df = spark.createDataFrame(rows + near, "k long, family long, component long, node long, n long, h array<long>")
    assert sorted(r["k"] for r in neardup.reachable(common.durable(df, "test"), 80).collect()) == [50, 51]


def test_near_duplicate_cases(spark, cases, empty):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(cases).collect())
    assert got[:9] == [(False, i, {5: 4}.get(i, i), i != 5) for i in range(9)]
    assert got[9:] == [(True, 0, 4, True)] * 2
    assert neardup.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "k l m n o p"), (2, "k l m n o p"), (0, "a b c d e f"), (3, "z")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(twice).collect()} == {(1, 0), (2, 0), (0, 0), (3, 3)}


@pytest.mark.parametrize("few", [10**6, 0])  # minima broadcast, or hubs dealt in parts
def test_connected_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "LEAST_HUB", 8)
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [tuple(map(int, e)) for e in rng.integers(200, 260, (30, 2))] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_packing(spark, cases, empty):
    got = packing.pack(cases).collect()
    ids = [np.append(np.frombuffer(x, "<u4"), 1) for x in wordbpe.word_ids()([t or "" for t in CASES])]
    for i, x in enumerate(ids):
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["length"] for r in mine] == [min(4096, len(x) - s) for s in range(0, len(x), 4096)]
        assert [r["start"] for r in mine] == list(range(0, len(x), 4096))
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(x[s : s + 4096].astype("<u4").tobytes()) for s in range(0, len(x), 4096)]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) == -(-sum(r["length"] for r in got) // 4096)
    assert packing.pack(empty).count() == 0
    assert [len(r["ids"]) for r in packing.pieces(cases, with_ids=True).where("doc_id = 3").collect()] == [2]


def test_media(spark, cases, empty):
    got = {r["doc_id"]: r for r in media.media_features(cases).where("doc_id IS NOT NULL").collect()}
    import hashlib

    for i, t in enumerate(CASES):
        payload, n = media.padded(t)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[4]["media_sha256"] == got[5]["media_sha256"] and got[4]["feature"] == got[5]["feature"]
    assert media.media_features(cases).count() == 11 and media.media_features(empty).count() == 0
    named = spark.createDataFrame([("null", "a"), (None, "b"), ("x/y-z.png", "c")], "doc_id string, text string")
    assert {(r["doc_id"], r["n_bytes"]) for r in media.media_features(named).collect()} == {("null", 1), (None, 1), ("x/y-z.png", 1)}


def test_media_stays_where_a_folder_is_given(spark, cases, tmp_path):
    media.media_features(cases, str(tmp_path)).count()
    read = media.read_archives(spark, str(tmp_path))
    assert {media.from_png(r["media"]) for r in read.collect()} == {media.padded(t)[0] for t in CASES}
    media.remove(str(tmp_path))
    assert not tmp_path.exists()


def test_secrets(spark, cases, empty):
    got = {r["doc_id"]: r for r in secrets.scan(cases).where("doc_id IS NOT NULL").collect()}
    assert got[8]["spans"] == "assign:0:19" and got[8]["n_assign"] == 1 and got[0]["spans"] == "" and len(got) == 9
    out = secrets.redact(cases)
    assert out.columns == cases.columns and out.where("doc_id = 8").first()["text"] == "token=[REDACTED] x" and out.count() == 11
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).count() == 0


def test_random_strings_after_signs_and_of_letters():
    for key in ("q7Zt9XvB2mKp4LsW8dRj6Yhc", "qZtXvBmKpLsWdRjYhcGnTfUe", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQpL7tKv"):
        for text in ("client_key=%s", "AWS_SECRET_ACCESS_KEY=%s\n", 'export KEY="%s"', "KEY='%s'", "key: %s", "key:%s", "https://h.org/p?sig=%s&x=1", "A_LONG_NAME_OF_A_VARIABLE==%s", "x = %s="):
            out = secrets.redacted(text % key)
            assert key not in out and "[REDACTED]" in out, (text, key)
    for word in ("internationalisation", "MAX_CHARS_PER_TOKEN_LIMIT", "getElementsByTagNameFromTree", "Donaudampfschifffahrtsgesellschaft", "some/long-path/of_words/123456", "x=550e8400-e29b-41d4-a716-446655440000"):
        assert secrets.redacted(word) == word


def test_quality(spark, cases, empty):
    good = [f"The cat number {i} sat on the mat. It was a fine day." for i in range(80)]
    bad = [f"|| x{i} || y || z || ||" for i in range(80)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 80), None) for i in range(160)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    m = quality.fit(docs, labels, common.crc_mod("doc_id", 4) != 2)
    got = {r["doc_id"]: r for r in quality.score(docs, m).collect()}
    assert all(got[i]["predicted"] == (i < 80) for i in range(160))
    assert quality.accepted(docs, m).count() == 80 and quality.accepted(docs, m).columns == docs.columns
    assert quality.score(cases, m).count() == 11 and quality.score(empty, m).count() == 0
    none = quality.fit(empty, labels, F.lit(True))
    assert {r["score"] for r in quality.score(cases, none).collect()} == {0.5}


def test_languages(spark, cases, empty):
    texts = ["the thing with that and this here", "el niño con las cosas que son de aquí"] * 30
    docs = documents(spark, texts, lang=["en", "es"] * 30)
    m = crf.fit(docs, common.crc_mod("doc_id", 5) != 0)
    assert {(r["doc_id"] % 2, r["lang_pred"]) for r in crf.identify(docs, m).collect()} == {(0, "en"), (1, "es")}
    got = {r["doc_id"]: r["lang_pred"] for r in crf.identify(cases, m).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] != "und"
    assert crf.identify(empty, m).count() == 0 and crf.fit(empty, F.lit(True)).labels == []


def test_pieces(spark, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [None, "", "Hello  world", "x" * 300, "thequick" * 90 + " and the other " * 30]
    docs = documents(spark, texts)
    null = spark.createDataFrame([(None, texts[4], None, None, None, None, None, None)] * 2, DOCS)
    found = pieces.report(docs.unionByName(null), chunk=100, fan=3).collect()
    got = {r["doc_id"]: r for r in found}
    assert sorted(r["ids_sum"] for r in found if r["doc_id"] is None) == [got[4]["ids_sum"]] * 2 and len(found) == 7
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        r = got[i]
        assert (r["n_ids"], r["ids_sum"], r["ids_weighted"], r["round_trip"]) == (len(ids), sum(ids), sum(k * x for k, x in enumerate(ids)), True)
    assert got[4]["parts"] > 1 and got[2]["parts"] == 1
    assert pieces.report(empty).count() == 0


def test_lines(spark, cases, empty):
    texts = [f"own {i}\nshared\n\nshared" for i in range(10)] + ["shared\nother"] * 2 + [None, ""]
    docs = documents(spark, texts, source=["a"] * 10 + ["b"] * 2 + [None, None])
    out = {r["doc_id"]: r["text"] for r in lines.drop_lines(docs).collect()}
    assert out[0] == "own 0\n" and out[10] == "shared\nother" and out[12] is None and out[13] == ""
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.report(docs).collect()}
    assert got[0] == (4, 2) and got[10] == (2, 0) and got[12] == (0, 0) and got[13] == (1, 0)
    nulls = documents(spark, ["same\nline %d" % i for i in range(5)])
    assert {r["text"] for r in lines.drop_lines(nulls).collect()} == {f"line {i}" for i in range(5)}
    assert lines.drop_lines(cases).columns == cases.columns and lines.drop_lines(empty).count() == 0


def test_lines_of_copies_stay_once(spark):
    rng = np.random.default_rng(8)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 20))
    base, tail = [line() for _ in range(10)], [line() for _ in range(10)]
    near = ["\n".join([*base[:k], f"v{k} " + base[k], *base[k + 1 :]]) for k in range(10)]
    texts = ["\n".join(tail)] * 12 + near + [f"menu\n{line()}" for _ in range(20)] + ["menu"]
    out = {r["doc_id"]: r["text"] for r in lines.drop_lines(documents(spark, texts, source=["a"] * len(texts))).collect()}
    assert [out[i] for i in range(12)] == texts[:12]  # exact copies are one page
    assert out[12] == near[0] and all(out[12 + k] == near[k].split("\n")[k] for k in range(1, 10))  # one near copy stays whole
    assert all(out[i] == texts[i].split("\n")[1] for i in range(22, 42)) and out[42] == "menu"


def test_urls(spark):
    link = '<html><link rel="canonical" href="%s"></html>'
    rows = [
        (1, "https://A.Example.com/en/1?x#y", None),  # blocked by its host's rule
        (2, "http://www.example.com/en/2", ""),  # allowed by the longer rule
        (3, "http://x.org/p", link % "http://b.example.com/en/3"),  # an alias of a blocked url
        (4, "http://y.org/q", '<META http-equiv="Refresh" content="0; url=http://x.org/p#top">'),  # an alias of an alias
        (5, "http://ok.com/r", link % "http://b.example.com/en/3"),  # allowed itself
        (6, None, link % "http://b.example.com/en/3"),
        (7, "no scheme", None),
        (8, "http://z.org/", link % "/other"),
        (9, "http://n.net/fr/", None),
        (10, "http://com/a", None),
        (11, "http://notcom?/en/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, urls.CONTRACT_RULES).collect()}
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3] == ("x.org", "/p", None, "block") and got[4][3] == "block" and got[5][2:] == ("com/", "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8][3] == "allow"
    assert got[9][2:] == ("net/fr/", "block") and got[10][2:] == ("com/", "allow") and got[11] == ("notcom", "", None, "allow")
    more = spark.createDataFrame([("http://z.org/", "http://y.org/q")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, urls.CONTRACT_RULES, more).collect()}[8] == "block"
    assert urls.judge(pages.limit(0), urls.CONTRACT_RULES).count() == 0


BLOCKED = "http://b.net/fr/z"
FORMS = [  # (url of the page, target, whether it names BLOCKED or an alias of it)
    ("http://a1.org/x/y", BLOCKED, True),
    ("http://a2.org/x/y", "//b.net/fr/z", True),
    ("http://a3.org/x/y", "https://B.net/fr/z#part", True),
    ("http://a4.org/x/y", "http://b.net/q/../fr/./z", True),
    ("http://a5.org/x/y", "../../q", False),
    ("http://a6.org/x/y?p=1", "?p=2", False),
    ("http://a7.org/i?id=1", BLOCKED, True),
    ("http://a7.org/i?id=2", "mailto:x@b.net", False),
    ("http://a8.org/c/d", "/root", True),
    ("http://a8.org/root", BLOCKED, True),
    ("http://a9.org/c/d", "page.html?k=1&amp;l=2", True),
    ("http://a9.org/c/page.html?k=1&l=2", BLOCKED, True),
    ("http://a9.org/c/page.html?k=1", "#top", False),
    ("http://a10.org/c/d/e", "../up", True),
    ("http://a10.org/c/up", BLOCKED, True),
    ("http://a11.org", BLOCKED, True),
    ("http://a11.org/?", "javascript:void(0)", False),
    ("http://a12.org/", "http://a11.org", True),
    ("http://a13.org/x", "a11.org/", False),
    ("http://a14.org/x/.", "..", True),
    ("http://a14.org/", BLOCKED, True),
    ("http://ok.com/x", BLOCKED, False),
    ("http://far.org/1", "http://far.org/2", True),
    ("http://far.org/2", "http://ok.com/x", True),
    ("no scheme", BLOCKED, False),
    (None, BLOCKED, False),
    ("http://empty.org/x", "", False),
]


def linked_pages(spark):
    html = ['<link rel="canonical" href="%s"> text', '<META http-equiv="Refresh" content="0; url=%s">', "<link href='%s' rel=canonical><p>"]
    rows = [(i, u, html[i % 3] % t) for i, (u, t, _) in enumerate(FORMS)]
    return spark.createDataFrame(rows + rows[:3] + [(100, "http://c.net/es/x", None)], "page_id long, url string, html string")


def test_targets_of_all_forms_are_resolved(spark):
    got = {r["page_id"]: r["verdict"] for r in urls.judge(linked_pages(spark), urls.CONTRACT_RULES).collect()}
    assert [got[i] for i in range(len(FORMS))] == ["block" if x else "allow" for *_, x in FORMS] and got[100] == "block"


def test_url_sql_with_links(spark, tmp_path):
    import duckdb

    linked_pages(spark).coalesce(1).write.parquet(str(tmp_path / "p"))
    want = duckdb.connect().execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'").execute(urls.ORACLE).fetchall()
    key = lambda r: [x or "" for x in r[1:]] + [r[0]]
    assert sorted(want, key=key) == sorted(map(tuple, urls.judge(linked_pages(spark), urls.CONTRACT_RULES).collect()), key=key)


def test_hash_tables_hold_all_boilerplate(spark):
    texts = ["\n".join(f"line {i}" for i in range(3000))] * 4 + ["\n".join(["mine", "line 7", "", "line 2999"])] + ["x\nmine 2"]
    docs = documents(spark, texts, source=["a"] * 5 + ["b"])
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.report(docs).collect()}
    assert got == {0: (3000, 3000), 1: (3000, 3000), 2: (3000, 3000), 3: (3000, 3000), 4: (4, 2), 5: (2, 0)}
    twice = docs.unionByName(docs)
    assert sorted(tuple(r)[1:] for r in lines.report(twice).collect())[-2:] == [(3000, 3000, "d41d8cd98f00b204e9800998ecf8427e")] * 2


def nearest_by_force(x, ids, q_ids, k):
    """Each query's (id, distance), nearest first, ties to the smaller id; a repeated row counts once."""
    out = {}
    for q in q_ids:
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        out[q] = sorted({(float(a), int(i)) for a, i in zip(d, ids) if i != q})[:k]
    return out


def asked(df, k=10, **more):
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), k, **more).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert all([n for n, *_ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, []), (None, [1.0] * 16), (300, x[300].tolist())]
    other = [(1000 + i, [1.0 + i, 2.0, 3.0]) for i in range(5)]  # vectors of another dimension
    t = spark.createDataFrame(rows + other, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = asked(t)
    want = nearest_by_force(x, np.arange(400), [0, 100, 200, 300], 10)
    assert {q: v for q, v in got.items() if q < 400} == want
    assert got[1000] == [(float(i), 1000 + i) for i in range(1, 5)] and len(got) == 5
    few = t.where("vec_id < 3")
    assert ann.search(few, few.where("vec_id = 0")).count() == 2
    assert ann.search(t.limit(0), t.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [1, 4])
def test_neighbours_of_repeated_rows_and_copies(spark, monkeypatch, partitions):
    monkeypatch.setattr(ann, "LIST_ROWS", 100)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 8))
    x[300:500] = x[200]  # a third holds one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    every = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("n").repartition(partitions)  # each row twenty times
    want = nearest_by_force(x, np.arange(600), range(0, 600, 100), 10)
    assert asked(every, exact=True) == want
    got = asked(every)
    assert got[200] == want[200] == [(0.0, i) for i in range(300, 310)]
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values())) and all(len(v) == 10 for v in got.values())


def test_recall_on_the_driver_s_vectors_and_in_a_tight_cluster(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 6000
    x = np.where(rng.random((n, 1)) < 1 / 3, rng.normal(size=64) + rng.normal(0, 0.01, (n, 64)), rng.normal(size=(n, 64)))  # a third in one cluster, all distinct
    tables = {"cluster": spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")}
    sf = "/root/testdata/sf0.01/embeddings.parquet"
    if os.path.exists(sf):
        monkeypatch.setattr(ann, "LIST_ROWS", 20)  # so that the small table has lists
        tables["embeddings"] = spark.read.parquet(sf)
    for name, t in tables.items():
        rows = t.collect()
        want = nearest_by_force(np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows]), [r["vec_id"] for r in rows if r["vec_id"] % 100 == 0], 10)
        got = asked(t)
        recall = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / sum(map(len, want.values()))
        print(f"recall on {name}: {recall:.3f}")
        assert recall >= 0.9


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))
