"""Operators against brute force on small fixtures."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from llm_frames import PROSE, SCHEMA, SENTENCES, clashing
from pyspark.sql import functions as F

from gustwatch.llm import components, decontaminate, license_scan, near_duplicates, pii, quality_classifier, quality_rules
from gustwatch.llm import repeated_passages, secret_scan, source_mix, url_filter
from gustwatch.llm.query_secret_scan import new_ledger


def _docs(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_cover_holds_every_difference():
    cover = repeated_passages.COVER
    found = sorted((a - b) % repeated_passages.PERIOD for a in cover for b in cover if a != b)
    assert found == list(range(1, repeated_passages.PERIOD))


@pytest.mark.parametrize("unit_bytes", [700, 6_000, 1 << 20])
def test_repeated_passages_against_all_windows(spark, unit_bytes):
    rng = random.Random(unit_bytes)
    letters = "abcdeé "
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice([150, 199, 200, 201, 400]))) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 250)))]
        for _ in range(rng.randrange(0, 4)):
            passage = rng.choice(passages)
            cut = rng.randrange(0, 30)
            parts += [passage[cut:], "".join(rng.choice(letters) for _ in range(rng.randrange(0, 90)))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "z" * 500, "", None]
    width = 200
    counts = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        counts.update(b[i : i + width] for i in range(len(b) - width + 1))
    expected = {}
    for i, b in enumerate(data):
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if counts[b[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        expected[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    how = repeated_passages.Passages(unit_bytes=unit_bytes)
    found = repeated_passages.remove_repeats(_docs(spark, texts).repartition(3), how).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == expected
    assert any(e[1] for e in expected.values())


def _shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    if not found:
        return set()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


@pytest.mark.parametrize("how", [near_duplicates.NEAR, near_duplicates.Near(words=5, percent=80, bands=32, rounds=1, block_shingles=300)])
def test_near_duplicates_against_all_pairs(spark, how):
    rng = random.Random(5)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 120]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 18))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), "one", "ONE", "one two", "", None, ""]
    sets = [_shingles(t or "", how.words) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union and 100 * len(sets[i] & sets[j]) >= how.percent * union:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.near_components(_docs(spark, texts), how).collect()}
    assert found == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}
    assert sum(k for _, _, k in found.values()) < len(texts) - 20


def test_signature_estimates_similarity():
    how = near_duplicates.Near(bands=64, rows=4)
    signer, rng = near_duplicates.Circulant(how), np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 100, 100))
    same = np.mean(signer(np.concatenate([shared, a])) == signer(np.concatenate([shared, b])))
    assert abs(same - 0.75) < 0.1


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 200)] + [(5, 5), (None, 3)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 200)}


def test_secret_spans_and_ledger(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = [
        f"Token: 'abcdefgh12' and {key} 0123456789abcdef0123456789abcdef",
        "password=short api_key = long_enough_1 secret:x",
        "-----BEGIN RSA PRIVATE KEY-----",
        "nothing here",
        None,
        "nothing here",
    ]
    ledger = new_ledger(spark)
    found = {r["path"]: r["s"] for r in secret_scan.scan_versions(_docs(spark, texts), ledger).select("path", secret_scan.joined(F.col("findings")).alias("s")).collect()}
    assert found[0] == "assign:0:18,access:24:44,hex:45:77"
    assert found[1] == "assign:15:38"
    assert found[2] == "private_key:0:31"
    assert found[3] == found[4] == found[5] == ""
    before = secret_scan.read_ledger(spark, ledger).count()
    assert before == 5 * len(secret_scan.RULES)
    # Nothing new to scan, then one new version of one path, then one raised rule version.
    secret_scan.scan_versions(_docs(spark, texts), ledger).count()
    assert secret_scan.read_ledger(spark, ledger).count() == before
    secret_scan.scan_versions(_docs(spark, texts[:3] + ["token=abcdefghij"]), ledger).count()
    assert secret_scan.read_ledger(spark, ledger).count() == before + len(secret_scan.RULES)
    raised = (secret_scan.Rule("hex", 2, re.compile("[0-9a-f]{32,}")), *secret_scan.RULES[:2])
    again = secret_scan.scan_versions(_docs(spark, texts), ledger, raised)
    assert secret_scan.read_ledger(spark, ledger).count() == before + len(secret_scan.RULES) + 5
    assert again.where(F.size("findings") > 0).count() == 2


def test_redaction(spark):
    docs = _docs(spark, ["my token=abcdefghij ok", "plain", None])
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, new_ledger(spark)).collect()}
    assert clean == {0: "my [SECRET] ok", 1: "plain", 2: None}


def test_mix_targets_by_iteration(spark):
    rng = random.Random(2)
    sources = [rng.choice(["a", "b", "c", "d", None, "é"]) for _ in range(300)]
    texts = [" ".join(["w"] * rng.choice([1, 5, 200 if s == "a" else 20])) for s in sources]
    rows = source_mix.mix_documents(_docs(spark, texts, sources)).collect()
    sizes = collections.Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(t.split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        free = total - sum(fixed.values())
        shares = {s: free * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if shares[s] > 2 * sizes[s]]
        if not over:
            break
        fixed |= {s: 2 * sizes[s] for s in over}
    goals = fixed | shares
    taken = collections.Counter()
    for r in rows:
        assert r["target"] == pytest.approx(goals[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        assert all(0 <= p <= 1 for p in r["positions"])
    assert all(abs(taken[s] - goals[s]) <= 1 for s in names)
    again = source_mix.mix_documents(_docs(spark, texts, sources).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    order = source_mix.training_order(source_mix.mix_documents(_docs(spark, texts, sources))).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)


def test_schedule_is_inverted(spark):
    schedule = ((0.0, 0.5), (0.25, 1.0), (1.0, 1.5))
    shares = spark.createDataFrame([(k / 20,) for k in range(20)], "s double")
    for r in shares.select("s", source_mix.time_of(F.col("s"), schedule).alias("t")).collect():
        grid = np.linspace(0, r["t"], 20001)
        density = np.interp(grid, [0, 0.25, 1], [0.5, 1.0, 1.5])
        whole = (0.5 + 1.0) / 2 * 0.25 + (1.0 + 1.5) / 2 * 0.75
        assert np.sum((density[1:] + density[:-1]) / 2 * np.diff(grid)) / whole == pytest.approx(r["s"], abs=1e-6)


def test_personal_data_spans():
    text = "a..b@x.org, me@@y.de z@w.com.net 1.2.3.4.5.6.7.8 999.1.1.1 x 4111 1111 1111 1111 +1 (663) 555-6869 +12"
    names = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)]
    assert names == [
        ("email", "a..b@x.org"),
        ("email", "z@w.com.net"),
        ("ip", "1.2.3.4"),
        ("ip", "5.6.7.8"),
        ("card", "4111 1111 1111 1111"),
        ("phone", "+1 (663) 555-6869"),
    ]
    slow = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("a.@-_% é") for _ in range(30))
        assert list(pii._emails(t)) == [m.span() for m in slow.finditer(t)]


def test_disclosing_terms(spark):
    texts = [f"Ask Zebedee about {i} things, mail zeb@corp.org or wait number{'abcdefgh'[i]} here" for i in range(5)]
    texts += [f"They mail people about things {i} often, wait here" for i in range(30)]
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(_docs(spark, texts), pii.Disclosure(reach=6)).collect()}
    terms = {texts[i][s["start"] : s["end"]].lower() for i, spans in found.items() for s in spans if s["kind"] == 4}
    assert terms == {"zebedee"}
    assert all(any(s["kind"] == 0 for s in found[i]) for i in range(5))
    assert not any(found[i] for i in range(5, 35))
    clean = pii.sanitised(texts[0], [s.asDict() for s in found[0]])
    assert "[EMAIL]" in clean and "Zebedee" not in clean


def _told(spark, texts):
    rows = pii.find_personal_data(_docs(spark, texts)).collect()
    return {texts[r["doc_id"]][s["start"] : s["end"]] for r in rows for s in r["spans"] if s["kind"] == 4}


def test_disclosing_terms_of_any_length_and_distance(spark):
    filler = "the plan of the week was read and then put off once more to the next one"
    odd = ["red", "blue", "green", "grey"]
    texts = [f"{name} and {filler} {'. ' * 60} {c} mail {mail}" for name, mail in (("Lee", "l@x.org"), ("王明", "w@y.org"), ("\u0130nci", "i@z.org")) for c in odd]
    texts += [f"{filler}{end} and mail {c}" for c in odd for end in ("", " again")]
    assert _told(spark, texts) == {"Lee", "王明", "\u0130nci"}


def test_a_term_tells_nothing_of_an_entity_that_is_everywhere(spark):
    texts = [f"Quillon {c} mail all@x.org" for c in ("red", "blue", "green")] + [f"others {c} mail all@x.org" for c in ("one", "two")]
    assert _told(spark, texts) == set()


BAKERY = "Our little bakery serves croissants marmalade pretzels cinnamon daily contact info@bakery.org for catering"


def _others(n):
    rng = random.Random(4)
    return [" ".join("".join(rng.choice("klmorstu") + rng.choice("aeiou") for _ in range(2)) for _ in range(12)) for _ in range(n)]


@pytest.mark.parametrize("copies", [4, 40])
def test_words_of_near_copies_disclose_nothing(spark, copies):
    others = _others(200)
    near = [f"{BAKERY} {others[i].split()[0]} {i}" for i in range(copies)]
    named = [f"{t} Zebedee Quillon {u} mail zeb@corp.org" for t, u in zip(others[50:54], others[60:64], strict=True)]
    assert _told(spark, near + named + others) == {"Zebedee", "Quillon", "mail"}


def test_a_wording_in_independent_texts_discloses(spark):
    others = _others(200)
    phrase = "Zebedee Quillon Amaranth Throckmorton Featherstone"
    texts = [f"{t} {phrase} {u} zeb@corp.org" for t, u in zip(others[50:54], others[60:64], strict=True)]
    assert _told(spark, texts + others) == set(phrase.split())
    copies = [f"{others[70]} {phrase} {others[71]} zeb@corp.org {'x' * i}" for i in range(1, 40)]
    assert _told(spark, copies + others) == set()


def test_lists_of_entities_and_terms_are_paired_as_one(spark):
    others = _others(200)
    staff = " ".join(f"n{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]} p{i}@x.org" for i in range(100))
    around = [" ".join(others[60 * k : 60 * k + 50]) for k in range(3)]
    texts = [f"{text} {staff}" for text in around] + others
    assert len(_told(spark, texts)) == 100


def test_license_places(spark):
    texts = [
        "Released under the MIT License. Again under the mit-license",
        "Licensed under the Apache License, Version 2.0.",
        "by cc by nc cc by nc",
        "permission is hereby granted free of charge",
        "mit license under the",
    ]
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(_docs(spark, texts)).collect()}
    at = {i: [(p["start"], license_scan.NOTICES[p["notice"]].label) for p in r["places"]] for i, r in rows.items()}
    assert at == {0: [(1, "mit"), (6, "mit")], 1: [(3, "apache-2")], 2: [(1, "cc-by-nc"), (4, "cc-by-nc")], 3: [(0, "mit")], 4: []}
    assert rows[1]["places"][0]["share"] == 1.0


def test_license_places_against_brute_force(spark):
    rng = random.Random(9)
    pool = sorted({w for n in license_scan.NOTICES for w in n.key})
    texts = []
    for _ in range(60):
        parts = [rng.choice([rng.choice(license_scan.NOTICES).text, rng.choice(license_scan.NOTICES).phrase, rng.choice(pool)]) for _ in range(8)]
        texts.append(" ".join(parts))
    for row in license_scan.scan_licenses(_docs(spark, texts)).collect():
        words = texts[row["doc_id"]].split()
        slow = {
            (i, k)
            for i in range(len(words))
            for k, n in enumerate(license_scan.NOTICES)
            if words[i : i + len(n.key)] == n.key
        }
        assert [(p["start"], p["notice"]) for p in row["places"]] == sorted(slow)


def test_license_look_ups_are_the_rarest_words():
    notices = (license_scan.Notice("x", "a b c", "a b c"), license_scan.Notice("y", "c", "c"))
    assert license_scan.look_ups(notices, {"a": 0.5, "b": 3.0, "c": 1.0}) == [[("b", 1), ("c", 2)], [("c", 0), ("c", 0)]]


def test_redirect_equivalence(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://bad.org/a", '<link rel="canonical" href="http://hub.org/1">'),
            (2, "http://hub.org/1#top", ""),
            (3, "https://alias.org/x.html?utm_source=f", '<meta http-equiv="refresh" content="0;url=http://hub.org/1">'),
            (4, "http://good.org/b", "<link href='//mixed.org/2' rel='canonical'>"),
            (5, "http://mixed.org/2", "<link rel=canonical href=http://bad.org/z>"),
            (6, "http://free.org/", None),
            (7, "http://bad.org/z", None),
        ],
        "page_id long, url string, html string",
    )
    rules = url_filter.rule_table(spark, [("bad.org", "/", "block"), ("good.org", "/", "allow")])
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules).collect()}
    assert found == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}


def test_link_targets_are_resolved(spark):
    links = [
        ("http://a.org/d/e?q#f", "page2", "http://a.org/d/page2"),
        ("http://a.org/d/e", "../x?id=1", "http://a.org/x?id=1"),
        ("http://a.org/d/e", "../../../x/.", "http://a.org/x/"),
        ("http://a.org/d/e", "?id=3", "http://a.org/d/e?id=3"),
        ("http://a.org", "x", "http://a.org/x"),
        ("http://a.org?p", "?q", "http://a.org?q"),
        ("http://a.org/d/e?p#f", "#top", "http://a.org/d/e?p#top"),
        ("https://a.org/d", "//b.org/x", "https://b.org/x"),
        ("http://a.org/d", "/go?u=http://b.org/", "http://a.org/go?u=http://b.org/"),
        ("http://a.org/d", "http://b.org/x/../y?a=1&amp;b=2&#38;c=3", "http://b.org/y?a=1&b=2&c=3"),
        ("http://a.org/d", "mailto:me@b.org", None),
        ("no scheme", "x", None),
    ]
    rows = spark.createDataFrame([(u, f"<link rel='canonical' href='{t}'>", e) for u, t, e in links], "url string, html string, e string")
    for r in rows.select("url", "e", url_filter.link_targets(F.col("url"), F.col("html")).alias("t")).collect():
        assert r["t"] == ([r["e"]] if r["e"] else []), r
    based = [
        ("http://a.org/d/e", "<base href='/up/'><link rel='canonical' href='x'>", ["http://a.org/up/x"]),
        ("no scheme", "<BASE target=_top href=http://b.org/d/e><link href=x rel=canonical>", ["http://b.org/d/x"]),
    ]
    rows = spark.createDataFrame(based, "url string, html string, e array<string>")
    for r in rows.select("e", url_filter.link_targets(F.col("url"), F.col("html")).alias("t")).collect():
        assert r["t"] == r["e"]


def test_aliases_by_relative_links_and_either_attribute_order(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://one.org/", '<meta content="0;url=http://bad.org/a" http-equiv="refresh">'),
            (2, "http://two.org/d/e", "<link rel=canonical href='../hub'>"),
            (3, "http://two.org/hub", "<meta http-equiv=refresh content='0; url=http://bad.org/?a=1&amp;b=2'>"),
            (4, "http://good.org/?a=1&b=2", None),
            (5, "http://four.org/", "<link rel=canonical href='http://good.org/?a=1&amp;b=2'>"),
            (6, "http://five.org/", "<base href='http://bad.org/d/'><link rel=canonical href=x>"),
            (7, "http://six.org/", "<base href='http://bad.org/d/'>"),
        ],
        "page_id long, url string, html string",
    )
    rules = url_filter.rule_table(spark, [("bad.org", "/", "block"), ("four.org", "/", "block"), ("good.org", "/", "allow")])
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules).collect()}
    assert found == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow"}


def test_benchmark_blocks_agree(spark, monkeypatch):
    items = spark.createDataFrame([(1, PROSE), (2, "lazy dog"), (3, "word7 follows word8"), (4, PROSE)], "item_id long, text string")
    docs = _docs(spark, [PROSE + " " + SENTENCES, "The QUICK brown, fox!", PROSE.upper(), ""])
    one = [tuple(r["__hits"]) for r in decontaminate.add_hits(docs, items).orderBy("doc_id").collect()]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    several = [tuple(r["__hits"]) for r in decontaminate.add_hits(docs, items).orderBy("doc_id").collect()]
    assert one == several
    assert one[0][2] == ["1", "2", "3", "4"] and one[1][1] == []
    assert decontaminate.places("The Lazy, dog ran", [1, 3]) == [(4, 13)]


def test_benchmark_ids_are_strings_and_blocks_come_one_by_one(spark, monkeypatch):
    items = spark.createDataFrame([("b/2", "lazy dog"), ("b/10", "lazy dog"), (None, "quick brown"), ("c", "word7 follows")], "item_id string, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)
    blocks, written = [], []
    scanner, write = decontaminate._scanner, decontaminate.materialize
    monkeypatch.setattr(decontaminate, "_scanner", lambda found, width: blocks.append((len(found), len(written))) or scanner(found, width))
    monkeypatch.setattr(decontaminate, "materialize", lambda df: written.append(1) or write(df))
    docs = clashing(_docs(spark, ["The LAZY dog, a quick brown one", "nothing here", None]))
    found = [tuple(r["__hits"]) for r in decontaminate.add_hits(docs, items).orderBy("doc_id").collect()]
    assert found == [(7, [1, 3, 4, 6], ["b/10", "b/2"]), (2, [], []), (0, [], [])]
    # Each block is fetched when what the blocks before it found has been written.
    assert blocks == [(1, 0), (1, 1), (1, 2), (1, 3)]


def test_classifier_learns_held_out(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    texts, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        words = [rng.choice(vocabulary) for _ in range(60)]
        texts.append(" ".join(words) + "." if good else " ".join(w + rng.choice(["###", "$$$"]) for w in words))
        labels.append((i, int(good)))
    docs = _docs(spark, texts)
    known = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, label int")
    model = quality_classifier.fit(docs, known)
    scored = {r["doc_id"]: r["score"] for r in quality_classifier.add_score(docs, model).collect()}
    held = [(scored[i] >= 0.5) == bool(y) for i, y in labels if i % 4 == 0]
    assert np.mean(held) > 0.95
    assert 0.25 <= model.temperature <= 8
    assert quality_classifier.fit(docs, known.where("label = 1")) is None


def test_links_are_tags_with_their_own_attributes(spark):
    from pyspark.sql import functions as F

    cases = [
        ("<!-- <link rel=canonical href='http://x.org/a'> -->", []),
        ("<script>var s = \"<link rel='canonical' href='http://x.org/a'>\";</script>", []),
        ("<STYLE>/* <link rel=canonical href=http://x.org/a> */", []),
        ("<link rel=canonical data-href='http://x.org/a'>", []),
        ("<link rel='canonical-old' href='http://x.org/a'>", []),
        ("<link title='rel=canonical' href='http://x.org/a' rel=next>", []),
        ("<links rel=canonical href='http://x.org/a'>", []),
        ("<link rel=canonical href=''>", []),
        ("<meta http-equiv=refresh content='5'> <link rel=canonical>", []),
        ("<link rel='alternate canonical' href='http://x.org/a'>", ["http://x.org/a"]),
        ("<link HREF=\"http://x.org/a\"\n REL = \"Canonical\" />", ["http://x.org/a"]),
        ("<!-- a --><link data-href=b href=http://x.org/a rel=canonical><!-- c", ["http://x.org/a"]),
        ("<meta content=\"0; URL='http://x.org/a'\" http-equiv=\"Refresh\">", ["http://x.org/a"]),
        ("<script>1</script><base target=_top href='/d/'><link rel=canonical href=a><script>2</script>", ["http://h.org/d/a"]),
    ]
    pages = spark.createDataFrame([(k, "http://h.org/p", h) for k, (h, _) in enumerate(cases)], "k int, url string, html string")
    found = {r["k"]: r["t"] for r in pages.select("k", url_filter.link_targets(F.col("url"), F.col("html")).alias("t")).collect()}
    assert [found[k] for k in range(len(cases))] == [t for _, t in cases]


def test_spelling_is_a_parameter(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/", None), (2, "http://a.net/es.html?ref=z", None)], "page_id long, url string, html string")
    rules = url_filter.rule_table(spark, [("net", "/es/", "block")])
    verdicts = lambda **how: {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules, **how).collect()}
    assert verdicts() == {1: "block", 2: "block"}
    assert verdicts(spelling=False) == {1: "block", 2: "allow"}


def _clean(spark, text):
    row = quality_rules.line_quality(_docs(spark, [text])).first()
    return row["clean_text"].split("\n") if row["clean_text"] else []


def test_lines_fail_as_menus_navigation_and_boilerplate(spark):
    prose = "A long line of prose that mentions the privacy policy once " + "and goes on for many more words " * 5 + "to its end."
    barred = "one two three four five six seven | " * 3 + "eight nine ten eleven twelve thirteen fourteen fifteen."
    menu = ["About our company", "Terms and conditions apply", "Contact the sales team"]
    assert _clean(spark, "\n".join([prose, *menu, barred])) == [prose, barred]
    assert _clean(spark, "\n".join([menu[0], prose, menu[1], menu[2]])) == [menu[0], prose, menu[1], menu[2]]
    assert _clean(spark, "Home | News | Sport | Weather\nRead our privacy policy here.\nhi") == []
    assert _clean(spark, "\n".join([*menu, "", menu[0]])) == []
