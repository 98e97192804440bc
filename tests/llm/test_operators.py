"""The text operators against brute force on small fixtures, with nulls, empty texts, repeated rows and clashing columns."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphfield.llm import common, decontaminate, html_tree, jaccard_join, language, packing, pii, quality_model, rules, substrings, warc
from graphfield.llm.common import Ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, start int"


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(3)
    vocabulary = {"en": ["the", "of", "thing", "wash", "other", "that"], "de": ["die", "und", "schön", "über", "nicht", "ein"]}
    out = {}
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        n = int(r.choice([12, 40, 90]))
        out[i] = (" ".join(r.choice(vocabulary[lang], n).tolist() + [f"w{i}{k}" for k in range(8)]), lang)
    base = " ".join(f"q{k}" for k in range(80))
    out[60], out[61], out[62] = (base, "en"), (base, "en"), (base.replace("q40", "z"), "en")
    out[63], out[64], out[65], out[66] = ("", "en"), (None, "en"), ("one two", "en"), ("- 12 -", "en")
    out[67] = ("Mail a.b@c.org or +49 (30) 1234567, 10.0.0.1 and 4111 1111 1111 1111; again 4111-1111-1111-1111 and 4111.1111.1111.1111", "en")
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, lang, "s", None, "x", 1) for i, (t, lang) in texts.items()]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_decontaminate(spark, docs, empty, texts):
    items = [(1, " ".join(texts[7][0].split()[3:20])), (2, "ONE two"), (3, None), (4, ""), (None, "the of"), (2, "one two"), (12, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in items:
        w = word.findall((t or "").lower())
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for size in (2_000_000, 1):
        got = by_id(decontaminate.find(docs, bench, block_bytes=size))
        for i, (t, _) in texts.items():
            w = word.findall((t or "").lower())
            at = [(k, p, v) for p, v in windows.items() for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p]
            hit, found = {k + j for k, p, _ in at for j in range(len(p))}, set().union(*(v for *_, v in at))
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert sum(s["end"] - s["first"] for s in r["spans"]) == len(hit)
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert 7 not in kept and 65 not in kept and 60 not in kept and 64 in kept
    assert decontaminate.find(empty, bench).count() == 0
    assert not any(r["n_hit"] for r in decontaminate.find(docs, bench.limit(0)).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=5))
def test_fm_index(symbols, phrases):
    f = decontaminate.FMIndex(np.array(symbols), 3, 4)
    lo, hi = f.search([np.array(p) for p in phrases])
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(symbols) - len(p) + 1) if symbols[i : i + len(p)] == p]
        assert sorted(f.locate(np.arange(a, b)).tolist()) == want


def test_language(docs, empty, texts):
    trees = language.learn(docs, usable=language.fold() != 2)
    got = by_id(language.predict(docs, trees))
    for i, (_, lang) in texts.items():
        if i < 60:
            assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
    assert got[63]["lang_pred"] == got[64]["lang_pred"] == got[66]["lang_pred"] == "und"
    assert {r["doc_id"] for r in language.accept(docs, trees).collect()} == set(texts) - {63, 64, 66}
    assert language.learn(empty).langs == [] and by_id(language.predict(docs, language.learn(empty)))[1]["lang_pred"] == "und"
    assert language.predict(empty, trees).count() == 0


def brute_costs(samples: list[bytes], text: bytes, order: int) -> float:
    """Code length of a text in bits, by the definition: escapes down to the longest context that knows the byte."""
    follow: dict[bytes, Counter] = {}
    for s in samples:
        s = b" " * order + s
        for i in range(order, len(s)):
            for k in range(order + 1):
                follow.setdefault(s[i - k : i], Counter())[s[i]] += 1
    total, text = 0, b" " * order + text
    for i in range(order, len(text)):
        for k in range(order, -1, -1):
            f = follow.get(text[i - k : i], Counter())
            n = sum(f.values()) + len(f)
            if text[i] in f:
                total += round(-np.log2(f[text[i]] / n) * language.UNIT)
                break
            total += round(-np.log2(len(f) / n) * language.UNIT) if f else 0
        else:
            total += 8 * language.UNIT
    return total


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=30), min_size=1, max_size=3), st.lists(st.text("ab c1", max_size=30), min_size=1, max_size=3), st.lists(st.text("abc 1d\u00fc", max_size=40), min_size=1, max_size=4))
def test_code_lengths(one, two, texts):
    """Vectorised costs equal the definition's, whole texts, over slice borders too."""
    one, two, texts = [t.lower() for t in one], [t.encode() for t in two], [t.encode() for t in texts]
    t = language.Trees({"a": one, "b": two}, 3)
    old, language.SLICE = language.SLICE, 7
    try:
        got = t.lengths(texts)
    finally:
        language.SLICE = old
    assert got.tolist() == [[brute_costs(one, x, 3), brute_costs(two, x, 3)] for x in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"ba", b"x" * 64, b"x" * 65, b"y" * 300, "\u00fc\u00df".encode()]), max_size=40), st.sampled_from([1 << 20, 100, 64]))
def test_word_hashes(words, size):
    """Equal words have equal hashes, others differ, wherever they stand and however the text is sliced."""
    old, common.SLICE = common.SLICE, size
    try:
        h = Ids().of(words)
    finally:
        common.SLICE = old
    alone = {w: int(Ids().of([w])[0]) for w in set(words)}
    assert len(set(alone.values())) == len(alone)
    assert [int(x) for x in h] == [alone[w] for w in words]


def test_letters():
    assert [language.lettered(t.encode()) for t in ("\u00bd", "12 \u00b2", "\u2460", "\u00fc", "\u4e2d", "a", "", "_-")] == [False, False, False, True, True, True, False, False]
    assert not language.lettered(None)


def test_pii(docs, empty):
    got = by_id(pii.find(docs))
    r = got[67]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["n_added"]) == (1, 1, 2, 1, 1)
    assert len(r["spans"].split(",")) == 6 and got[64]["spans"] == ""
    text = pii.mask(docs).where("doc_id = 67").first()
    assert "4111" not in text["text"] and "<email>" in text["text"] and text["n_chars"] == len(text["text"])
    assert pii.find(empty).count() == 0


def test_pii_potentials_are_learned():
    """Equal tokens that agree keep a strong skip potential; where they disagree it falls."""
    text = "id 4111 1111 1111 1111 and 4111 1111 1111 1111"
    seen = pii.nodes(text, pii.base(text))
    x, links = np.array([pii.features(text, a, b) for a, b, _, _ in seen]), pii.linked([n[2] for n in seen])
    same, apart = pii.fit([(x, [3, 3], links)] * 200), pii.fit([(x, [3, 0], links)] * 200)
    assert same.potentials["skip"] > pii.PRIORS["skip"] - 0.5 > apart.potentials["skip"] + 1
    assert links == {"chain": [], "skip": [(0, 1)], "similar": []}


def test_pii_without_base_matches_and_long_texts():
    field = pii.fit([])
    assert pii.scan("call 030 1234567 or 030 1234567", field) == ({k: [] for k in pii.KINDS},) * 2
    text = "a.b@c.org 4111 1111 1111 1111 or +49 30 1234567 or 12345678901 or " * 6000
    began = time.process_time()
    found, every = pii.scan(text, field)
    assert [len(found[k]) for k in pii.KINDS] == [6000, 0, 6000, 6000] and time.process_time() - began < 20
    a, b = found["card"][0]
    assert text[a:b] == "4111 1111 1111 1111" and all(set(found[k]) <= set(every[k]) for k in pii.KINDS)


@settings(max_examples=300, deadline=None)
@given(st.text("4 -15", max_size=60))
def test_base_cards(text):
    def good(s):
        d = re.sub(r"[^0-9]", "", s)
        odd, even = [int(c) for c in d[-1::-2]], [2 * int(c) for c in d[-2::-2]]
        return 16 <= len(d) <= 19 and (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0

    assert pii.base(text)["card"] == [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if good(m[0])]


@settings(max_examples=200, deadline=None)
@given(st.text("a1.@+- (4)5_%", max_size=40))
def test_base_patterns(text):
    found = pii.base(text)
    assert found["email"] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert found["ip"] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    assert found["phone"] == [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_rules(spark, docs, empty, texts):
    got = by_id(rules.apply(docs, [(("distinct_share", "<=", 0.2),)]))
    for i, (t, _) in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(w), len(hit), sum(map(len, w)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and (not r["base_failed"] or not r["kept"])
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    noisy = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30)) + ("!!! ### " * 10 if i % 3 == 0 else ".")) for i in range(60)], "doc_id long, text string")
    learned = rules.cover(*rules.counted(noisy, labels))
    judged = by_id(rules.apply(noisy, learned))
    assert learned and all(judged[i]["kept"] == (i % 3 > 0) for i in range(60))
    assert rules.cover(*rules.counted(docs, labels.limit(0))) == [] and rules.apply(empty, []).count() == 0


def test_jaccard(docs, empty, texts):
    sets = {}
    for i, (t, _) in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    parent = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    got = by_id(jaccard_join.join(docs))
    for i in texts:
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), parent[i])
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i in texts if parent[i] == i})
    assert jaccard_join.join(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 300), st.integers(0, 30), st.integers(0, 30), st.integers(0, 2**32), st.sampled_from([80, 90]))
def test_linked_sets_share_a_signature(size, drop, more, seed, percent):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
    b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**63, more).astype(np.uint64)]))
    if len(b) and jaccard_join.linked(a, b, percent) and not np.array_equal(a, b):
        s = jaccard_join.Bands(percent)
        assert len(np.intersect1d(s.signatures(a), s.signatures(b)))


@pytest.mark.parametrize("few", [64, 4])
def test_jaccard_of_a_large_family(spark, monkeypatch, few):
    """Copies of one text with differing numbers of changed words: hot buckets, links and non-links; with small buckets of four, several rounds of pivots."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    r = np.random.default_rng(5)
    base, rows = [f"b{k}" for k in range(120)], []
    for i in range(70):
        w = list(base)
        for k in r.choice(120, r.integers(0, 6), replace=False):
            w[k] = f"c{i}x{k}"
        rows.append((i, " ".join(w)))
    ids = Ids()
    sets = {i: jaccard_join.shingles(t.encode(), ids) for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if jaccard_join.linked(sets[a], sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: got[i]["component_id"] for i in label} == label


def test_jaccard_counts_every_link(spark, monkeypatch):
    """Links of a family with copies, over several blocks, and of small ones, against brute force."""
    r = np.random.default_rng(6)
    base, rows = [f"b{k}" for k in range(120)], []
    for i in range(40):
        w = list(base)
        for k in r.choice(120, r.integers(0, 6), replace=False):
            w[k] = f"c{i}x{k}"
        rows += [(i, " ".join(w)), *([(100 + i, " ".join(w))] if i % 4 == 0 else [])]
    for i in range(10):
        w = [f"s{i}x{k}" for k in range(60)]
        rows += [(200 + 2 * i, " ".join(w)), (201 + 2 * i, " ".join([*w, "z"]))]
    rows += [(300, ""), (301, None), (302, "alone"), (None, rows[0][1])]
    ids = Ids()
    sets = {i: jaccard_join.shingles((t or "").encode(), ids) for i, t in rows if i is not None}
    want = {a: sum(a != b and len(sets[a]) > 0 and jaccard_join.linked(sets[a], sets[b]) for b in sets) for a in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1500, 200_000):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = by_id(jaccard_join.links(docs))
        assert {i: got[i]["n_links"] for i in want} == want and got[None]["n_links"] is None
        assert all(got[i]["class_size"] == sum(np.array_equal(sets[i], sets[j]) for j in sets) for i in range(40))
    assert jaccard_join.links(docs.limit(0)).count() == 0


def test_jaccard_of_rows_with_one_doc_id(spark):
    """Rows with one doc_id and different texts, and null ids, are compared with their own sets."""
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, three), (None, three), (None, three), (5, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.join(docs).collect()}
    assert got[2, 39] == got[3, 39] == got[1, 38] == 1 and got[4, 38] == 4 and got[None, 38] is None
    kept = sorted((str(r["doc_id"]), r["text"]) for r in jaccard_join.one_of_each(docs).collect())
    assert kept == sorted([("1", min((r["text"] for r in jaccard_join.one_of_each(docs.where("doc_id < 4")).collect()), key=str)), ("4", three), ("5", ""), ("None", "")])


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 80), st.integers(0, 80), st.integers(0, 2**32), st.sampled_from([80, 90]))
def test_sketches_never_lose_a_link(size, drop, more, seed, percent):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
    b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**63, more).astype(np.uint64)]))
    if len(b) and jaccard_join.linked(a, b, percent):
        assert jaccard_join.may_link(len(a), jaccard_join.sketch(a), len(b), jaccard_join.sketch(b), percent)


def test_equal_rows_spread_over_groups(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 400, "doc_id long, text string").repartition(2)
    got = packing.pack(docs, sequence=64, group_docs=20).groupBy("sequence_id").count().collect()
    assert len({r["sequence_id"] >> 32 for r in got}) > 10 and sum(r["count"] for r in got) == 400


def test_packing(docs, empty, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs, sequence=64, group_docs=16, with_ids=True).collect()
    ends, own = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        own.setdefault(r["doc_id"], {})[r["start"]] = r
    for spans in ends.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64
    for i, (t, _) in texts.items():
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert b"".join(own[i][k]["ids"] for k in sorted(own[i])) == np.array(want, "<u4").tobytes()
    assert packing.pack(empty).count() == 0
    assert packing.sequences(packing.pack(docs, sequence=64, with_ids=True), 64).where("length(ids) > 256").isEmpty()


@settings(max_examples=100, deadline=None)
@given(st.text("aZé'1,.<|ß İΣς́", max_size=30))
def test_chunks_are_the_tokenizer(text):
    ids = packing.encoded(text.encode(), packing.encoder(packing.default_tokenizer()), 1)
    want = [*packing.encoder(packing.default_tokenizer()).tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert np.frombuffer(ids, "<u4").tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=30))
def test_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets = packing.first_fit_decreasing(np.array(sizes, int), 10)
    room = []
    for n, b, o in zip(sizes, bins, offsets, strict=True):
        k = next((i for i, x in enumerate(room) if x >= n), len(room))
        room += [10] * (k == len(room))
        assert (k, 10 - room[k]) == (b, o)
        room[k] -= n


def test_warc(spark):
    html = {1: "<p>a", 2: "", 3: None, 4: "ü" * 50_000, 5: "<p>a", 6: "x" * 32_768, 7: "ü" * 50_000}
    pages = spark.createDataFrame([(i, f"http://x/{i}" if i % 2 else None, h, 1) for i, h in html.items()] + [(None, None, "<p>a", 1)], "page_id long, url string, html string, warc int")
    archives = warc.write(pages, segment=1000, archive=5000)
    got = {r["page_id"]: r for r in warc.read(archives, with_payload=True).collect()}
    assert len(got) == 8 and got[None]["refers_to"] == 1
    for i, h in html.items():
        payload = (h or "").encode()
        first = min(k for k, v in html.items() if (v or "") == (h or ""))
        r = got[i]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        assert i != first or bytes(r["payload"]) == payload
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")


def test_substrings(docs, empty, texts):
    words = {i: (t or "").split() for i, (t, _) in texts.items()}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = by_id(substrings.dedupe(docs))
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        r = got[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        assert r["kept_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert got[62]["n_removed"] and substrings.dedupe(empty).count() == 0


def test_html(spark):
    field = html_tree.learn(html_tree.labelled_pages(80), rounds=30)
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies here.</div><article><h1>A  title&nbsp;x</h1><p>First one.<br>More &amp; more. And more text here.<p>Second <b>bold</b> one, which is longer.</article><section class=comments><div class=comment><p>Nice post.</p></div></section><footer>&copy; me</footer></body></html>"
    assert html_tree.main_text(page, field) == "A title x\n\nFirst one. More & more. And more text here.\n\nSecond bold one, which is longer."
    pages = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (3, "v", "<<p a='", 3), (None, "w", "", 3)], "page_id long, url string, html string, n_chars int")
    rows = {r["page_id"]: r for r in html_tree.extract(pages, field).collect()}
    assert len(rows) == 4 and rows[2]["text"] == "" and rows[1]["n_chars"] == len(rows[1]["text"])
    wrong = total = 0
    for p in html_tree.labelled_pages(60, 77):
        nodes, pieces = html_tree.parse(p)
        belief, _ = field.marginals(nodes)
        for n, _ in pieces:
            k = n
            while nodes[k].label is None and nodes[k].parent >= 0:
                k = nodes[k].parent
            wrong, total = wrong + ((belief[n] > 0.5) != bool(nodes[k].label)), total + 1
    assert wrong < 0.03 * total


@pytest.mark.parametrize("tag", ["button", "select", "svg", "object", "noscript", "template", "math", "span", "p", "b"])
def test_unclosed_elements_end_with_their_parent(tag):
    """What follows an unclosed element's parent is kept; a block ends an unclosed button, select or svg."""
    nodes, pieces = html_tree.parse(f"<body><div><{tag}>in</div><article><p>first one</p><p>second</p></article>")
    assert [t for _, t in pieces][-2:] == ["first one", "second"]
    if tag in html_tree.BRIEF:
        assert [t for _, t in html_tree.parse(f"<article><{tag}>in<p>first</p>")[1]] == ["first"]


def test_head_ends_at_text_and_blocks():
    assert [t for _, t in html_tree.parse("<head><title>x</title><meta a=b><p>one<p>two")[1]] == ["one", "two"]
    assert [t for _, t in html_tree.parse("<head><script>a<b</script> <noscript><p>no</p></noscript></head>text <svg/>after <math><mi>x</mi></math>")[1]] == ["text after x"]
    assert html_tree.parse("<script>var a = 1; <p>never")[1] == []


def test_deep_and_long_pages_take_linear_time():
    n = 100_000
    for page in ("<div>" * n + "text", "<li><ol>" + "<div>" * n + "<li></li>" * n + "text", "<table><tr><td>" + "<div>" * n + "<p>x</div>" * 1000, "</b>" * n + "<i>" * n + "</b>" * n + "text", "<svg/>" * n + "text"):
        began = time.process_time()
        nodes, pieces = html_tree.parse(page)
        assert time.process_time() - began < 20 and pieces
    nodes, _ = html_tree.parse("<div>" * n + "text")
    assert len(nodes) == n + 1 and len(html_tree.TreeField().marginals(nodes)[0]) == n + 1


def test_quality(docs, empty):
    got = by_id(quality_model.score(docs))
    assert got[64]["score"] == 0 and not got[63]["kept"] and 0 <= got[1]["score"] <= 1
    assert quality_model.score(empty).count() == 0
    good, bad = (1, 1, 0, 0, 1, 0, 1, 0, 0, 1, 0, 0, 1), (1, -1, -1, 0, -1, -1, 1, 0, 0, 1, 0, 0, 0)
    table, prior = quality_model.fit_labellers(Counter({good: 90, bad: 10}))
    p = quality_model.posterior(np.array([good, bad]), table, prior)
    assert p[0] > 0.9 and p[1] < 0.1 and 0.8 < prior < 0.95


def test_quality_counts_every_document(spark):
    """The labellers' tables come from all vote patterns, however small the scorer's sample."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)) + ".") for i in range(400)] + [(400 + i, "## " * 30 + "!") for i in range(3)] + [(403, ""), (404, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(quality_model.votes(quality_model.measures(t.encode(), t.encode().split(), Ids().of(t.encode().split()))) for _, t in rows if t is not None)
    assert quality_model.patterns(docs) == want and len(want) == 3
    table, prior = quality_model.fit_labellers(want)
    got = quality_model.learn(docs, sample_docs=40)
    assert np.allclose(got.table, table) and got.prior == pytest.approx(prior)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_of_many_sizes_share_a_signature(percent):
    rng, bands = np.random.default_rng(3), jaccard_join.Bands(percent)
    for _ in range(1500):
        n = int(np.exp(rng.uniform(np.log(3), np.log(700))))
        pool = np.unique(rng.integers(1, 2**63, 3 * n).astype(np.uint64))
        pool = pool[rng.permutation(len(pool))]
        both = n - int(rng.integers(0, n * (100 - percent) // 100 + 1))
        more = int(rng.integers(0, max(1, both * 100 // percent - n + 1)))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + more]]))
        if jaccard_join.linked(a, b, percent) and not np.array_equal(a, b):
            assert len(np.intersect1d(bands.signatures(a), bands.signatures(b)))


def test_pipeline(spark, tmp_path):
    """All stages on a small folder against a brute-force version; nulls, repeats, copies, an extra column, empty tables."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    r = np.random.default_rng(9)
    words = [f"w{k}a" for k in range(300)]
    texts = {i: " ".join(r.choice(words, 60)) for i in range(30)}
    texts[30], texts[31], texts[32] = texts[3], texts[4] + " tail", " ".join(texts[5].split()[:50])
    texts[33], texts[34], texts[35], texts[36] = None, "", "12 ½ --", texts[7] + " mail a.b@c.org or +49 30 1234567"
    texts[37] = "x y z " + " ".join(texts[8].split()[5:20]) + " " + " ".join(r.choice(words, 40))
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or ""), "q") for i, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, start string"
    spark.createDataFrame([*rows, rows[9]], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(texts[8].split()[5:20])), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in left.items()}
    label = {i: i for i in left}
    for _ in range(3):
        for a in left:
            for b in left:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    item = texts[8].split()[5:20]
    held = {tuple(item[k : k + 10]) for k in range(6)}
    left = {i: t for i, t in left.items() if label[i] == i and not any(tuple(t.lower().split()[k : k + 10]) in held for k in range(len(t.split())))}
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    masked = {i: re.sub(r"a\.b@c\.org", "<email>", t).replace("+49 30 1234567", "<phone>") for i, t in left.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["doc_tokens"] for x in got} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}
    assert 30 not in left and 31 not in left and 36 not in left and 8 not in left and 37 not in left and len(got) == len(left) > 20
    empty = tmp_path / "empty"
    for name in ("documents", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_long_texts(spark):
    """One text of a million bytes among short ones, through the scans."""
    long = " ".join(f"wörd{k % 5000}" for k in range(120_000))
    docs = spark.createDataFrame([(1, "a short text here", "en"), (2, long, "de"), (3, None, "en")], "doc_id long, text string, lang string")
    n = len(long.split())
    assert by_id(pii.find(docs, pii.fit([])))[2]["n_spans"] == 0
    assert by_id(decontaminate.find(docs, spark.createDataFrame([(1, "short text"), (2, "wörd1 wörd2 wörd3")], "item_id long, text string")))[2]["n_hit"] == 72
    assert by_id(language.predict(docs, language.learn(docs)))[2]["lang_pred"] == "de"
    assert by_id(quality_model.score(docs))[2]["n_words"] == n
    assert by_id(substrings.dedupe(docs))[2]["n_words"] == n
    assert by_id(jaccard_join.join(docs))[2]["n_shingles"] == 5000
    pieces = packing.pack(docs).where("doc_id = 2").collect()
    assert sum(p["length"] for p in pieces) == pieces[0]["doc_tokens"] > n


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_as_many_signatures_as_said(percent):
    rng, bands = np.random.default_rng(4), jaccard_join.Bands(percent)
    tight = 0
    for _ in range(1500):
        n = int(np.exp(rng.uniform(np.log(8), np.log(700))))
        pool = np.unique(rng.integers(1, 2**62, 3 * n).astype(np.uint64))
        pool = pool[rng.permutation(len(pool))]
        both = n - int(rng.integers(0, n * (100 - percent) // 100 + 1))
        more = int(rng.integers(0, max(1, both * 100 // percent - n + 1)))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + more]]))
        if jaccard_join.linked(a, b, percent) and not np.array_equal(a, b):
            odd = min(bands.band(len(a)), bands.band(len(b))) % 2
            (x, sure), (y, other) = bands.signed(a), bands.signed(b)
            same = np.intersect1d(x, y)
            least = max(sure[odd], other[odd])
            assert np.count_nonzero((same & np.uint64(3)) == odd) >= least
            tight += least > 1
    assert tight > 100


def test_large_buckets_hold_no_strangers(spark, monkeypatch):
    """Strangers with a passage in common, beside a family, stay out of the large buckets; each node of those has one pivot a round and a few rows."""
    monkeypatch.setattr(jaccard_join, "FEW", 6)
    r = np.random.default_rng(8)
    base, passage, rows = [f"b{k}" for k in range(150)], [f"p{k}" for k in range(40)], []
    for i in range(60):
        rows.append((i, " ".join([*passage, *(f"s{i}x{k}" for k in range(130))])))
    for i in range(100, 160):
        w = list(base)
        for k in r.choice(150, r.integers(0, 7), replace=False):
            w[k] = f"c{i}x{k}"
        rows.append((i, " ".join(w)))
    ids = Ids()
    sets = {i: jaccard_join.shingles(t.encode(), ids, 5) for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if jaccard_join.linked(sets[a], sets[b], 80):
                    label[a] = label[b] = min(label[a], label[b])
    rounds, compare = [], jaccard_join.against_pivots

    def seen(pairs, nodes, *rest):
        out = compare(pairs, nodes, *rest)
        rounds.append(out.collect())
        return out

    monkeypatch.setattr(jaccard_join, "against_pivots", seen)
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80))
    assert {i: got[i]["component_id"] for i in label} == label and len(set(label.values())) > 60
    strangers = {int(jaccard_join.mixed(s).sum(dtype=np.uint64).view(np.int64)) for i, s in sets.items() if i < 60}
    assert rounds[0] and all(x["linked"] or len(x["far"]) <= 31 for rows in rounds for x in rows)
    for rows in rounds:
        assert len({x["a"] for x in rows}) == len(rows) and not strangers & {x["a"] for x in rows}


def test_kept_words_outlive_a_full_cache():
    """A word asked for again and again is found once, though the cache fills up several times."""
    found = Counter()
    kept = common.Kept(lambda w: found.update([w]) or w, 20 * (common.ENTRY_BYTES + 8))
    for i in range(100):
        assert kept[b"often"] == b"often" and kept[b"%d" % i] == b"%d" % i
    assert found[b"often"] == 1 and len(kept) + len(kept.old) <= 20


def test_marks_after_letters_are_tokenised_apart():
    chunks = packing.Chunks(packing.default_tokenizer())
    called, whole = [], chunks.tokenizer
    words = ["A$$$", "eathha.%%%", "This!!", "Über***", "x</p>", "it's", "o'", "a***b", "q'$", "A'S", "2x.", "ÿ~`^", "e\u0301...", "İ!"]
    want = [whole.encode(w, add_special_tokens=False).ids for w in words]
    chunks.tokenizer = type("Counted", (), {"encode": lambda self, t, **k: called.append(t) or whole.encode(t, **k)})()
    assert [np.frombuffer(chunks[w.encode()], "<u4").tolist() for w in words] == want
    assert not {"A$$$", "eathha.%%%", "This!!", "Über***"} & set(called)


def test_hashes_of_words_and_windows_are_as_defined():
    """Tabulation hashes up to the longest word, xxhash above, a slice at a time; window hashes word by word.  A guard of the values: they hold for any way to compute them."""
    import xxhash

    whole, r = (1 << 64) - 1, np.random.default_rng(1)

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & whole
        h = (h ^ h >> 27) * 0x94D049BB133111EB & whole
        return h ^ h >> 31

    def of(w):
        return xxhash.xxh64_intdigest(w) if len(w) > common.LONGEST else mix(sum(int(common.TABLE[i << 8 | c]) for i, c in enumerate(w)) & whole)

    words = [bytes(r.integers(33, 256, n).astype(np.uint8)) for n in [1, 2, 63, 64, 65, 66, 200, *r.integers(1, 12, 60)]]
    got = Ids.of(words)
    assert got.tolist() == [of(w) for w in words] and not len(Ids.of([]))
    assert Ids.of([words[0], b"x" * (2 * common.SLICE), words[1]]).tolist() == [of(words[0]), of(b"x" * (2 * common.SLICE)), of(words[1])]
    for k in (1, 5, 13):
        want = []
        for i in range(len(words) - k + 1):
            h = 77
            for x in got[i : i + k].tolist():
                h = (h ^ x) * 0xD6E8FEB86659FD93 & whole
                h ^= h >> 32
            want.append(mix(h))
        assert common.windows(got, k, 77).tolist() == want
