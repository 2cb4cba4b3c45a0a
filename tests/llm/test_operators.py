"""Each operator against brute force, exact round trips or held-out accuracy, and its edge cases."""

import hashlib
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import checksum, decontaminate, exact, html, langid, lm, minhash, packing, quality, queries, records, tokens, toxicity, words
from seqloom.llm.common import id_remainder, utf8_slices

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n=60, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}q" for x in rng.integers(0, vocabulary, n))


def make(spark, texts, **extra):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("chunk", F.lit(1)).withColumn("row", F.lit("x")).withColumn("score", F.lit(2.0))


ODD = [None, "", " \n ", "A b", "a B", "one", "x" * 70_000, "é ü ñ", prose(1), prose(1).upper(), prose(1)]


def test_checksum_of_known_values_and_mask():
    bs = [b"", b"123456789", bytes(range(200)) * 3, b"a"]
    at = np.cumsum([0, *map(len, bs)])
    got = checksum.crc32c(np.frombuffer(b"".join(bs), np.uint8), at)
    assert got[0] == 0 and got[1] == 0xE3069283
    alone = [checksum.crc32c(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for b in bs]
    assert got.tolist() == alone
    crc = int(got[1])
    assert int(checksum.masked(got)[1]) == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_words_and_shingles_match_plain_python():
    import pyarrow as pa

    texts = ["Ab c", "", "\x0bab  C\r\n d e", None, "q"]
    seen, kinds = {}, {}
    for _, _, buf, offsets in utf8_slices(pa.array(texts), 4):
        found = words.find_words(buf, offsets)
        h, where = words.shingle_hashes(found, 2)
        for i in range(len(offsets) - 1):
            own = bytes(buf[offsets[i] : offsets[i + 1]]).lower().split()
            assert len(own) == found.first[i + 1] - found.first[i]
            for w, x in zip(own, found.hashes[found.first[i] : found.first[i + 1]].tolist()):
                assert seen.setdefault(w, x) == x
            runs = [tuple(own[j : j + 2]) for j in range(max(1, len(own) - 1))] if own else []
            assert len(runs) == where[i + 1] - where[i]
            for r, x in zip(runs, h[where[i] : where[i + 1]].tolist()):
                assert kinds.setdefault(r, x) == x
    assert len(set(seen.values())) == len(seen) and len(set(kinds.values())) == len(kinds)


@pytest.mark.parametrize("name, byte_level", [(queries.WORD_TOKENIZER, False), (queries.BYTE_TOKENIZER, True)])
def test_pieces_give_the_ids_of_whole_texts(name, byte_level):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path(name)
    whole = Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    alphabet = list("abZ'1.!#\n \t  sé́ 　中\x1cß")
    texts = ["", " ", "a  b\n\nc", "it's  'll", "<|endoftext|> x", "a<|startoftext|>b <|endoftext|>", "don't\nStop. now!", *("".join(rng.choice(alphabet, 20)) for _ in range(500))]
    encoder = tokens.piece_encoder(path, byte_level)
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_op1_main_text():
    long = "Some prose, with commas, and more of it, " * 4
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav>
    <div class="cookie-notice"><p>{long}</div><div id=main><h1>Head &amp; line</h1><p>{long}<p>{long} <b>bold</b>&nbsp;end<br>x
    <script>var a="</p>";</script><form><p>{long}</form></div><div class="comments"><p>{long}</div><aside><p>{long}</aside>
    <footer><p>{long}</p></footer></body>"""
    clean = long.strip()
    assert html.main_text(page) == f"Head & line\n{clean}\n{clean} bold end x"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text("just words") == "just words"
    assert html.main_text("<div><p>" * 3000 + "deep") == "deep"


def test_op1_keeps_all_parts_of_an_article():
    one, two, three = (f"Part {n} has prose, with commas, and more of it, and then yet more of it, and an end." for n in ("one", "two", "three"))
    text = lambda body: html.main_text(f"<body><nav><a href=x>Menu</a></nav>{body}</body>")
    assert text(f"<main><h1>Title</h1><article><p>{one}<p>{two}</article></main>") == f"Title\n{one}\n{two}"
    assert text(f"<main><header><h1>Title</h1></header><article><p>{one}</article></main>") == f"Title\n{one}"
    assert text(f"<main><h1>Title</h1><article><p>{one}</article><article><p>{two}</article></main>") == f"Title\n{one}\n{two}"
    assert text(f"<main><h1>Title</h1><div><article><p>{one}</article></div><section><p>{two}</section></main>") == f"Title\n{one}\n{two}"
    between = "<h3>Head</h3><ul><li>first<li>second</ul><pre>code</pre><table><tr><td>cell</table><ul><li><a href=x>other pages</a></ul>"
    page = f"<div><div><p>{one * 3}</div>{between}<blockquote>quoted</blockquote><p>{three}</div>"
    assert text(page) == f"{one * 3}\nHead\nfirst\nsecond\ncode\ncell\nquoted\n{three}"


def test_op1_broken_pages_take_linear_time():
    prose = "Words of the article, with a comma, that go on and on until they come to an end. " * 3
    began = time.monotonic()
    for page in ('<a title="x ' * 90_000, "<svg>" * 150_000, "</svg <svg " * 90_000, "<a b='\">" * 100_000, "<!-- " * 200_000, "<a =" + " " * 10**6):
        assert html.main_text(page) == ""
        assert html.main_text(f"<article><p>{prose}</p></article>{page}") == prose.strip()
    assert html.main_text("<b>" * 20_000 + "</i>" * 20_000 + "deep") == "deep"
    assert time.monotonic() - began < 20
    # A quote that is never closed ends with its tag; one outside of a value opens nothing.
    assert html.main_text(f'<article><p title="x>{prose}</p></article>') == prose.strip()
    assert html.main_text(f'<article><p " class=x>{prose}</p><p title="a > b">{prose}</p></article>') == f"{prose.strip()}\n{prose.strip()}"


def test_op1_equal_siblings_and_named_paragraphs():
    parts = [f"Part {n} is short, but it is as good as the others, and all of them stay." for n in ("one", "two", "three")]
    assert html.main_text("<body>" + "".join(f"<div><p>{p}</p></div>" for p in parts) + "</body>") == "\n".join(parts)
    law = "The law says, in many words, what it has to say, and then it says so again. " * 8
    for tag in ("p", "div"):
        inner = law if tag == "p" else f"<p>{law}</p>"
        assert law.strip() in html.main_text(f'<article><p>{law}one</p><{tag} class="legal text">{inner}</{tag}></article>').split("\n")
    notice = f"<article><p>{law}</p></article><p class=notice>We use cookies.</p>"
    assert html.main_text(notice) == law.strip()


def test_op1_rows(spark):
    rows = [(1, "u", "<article><p>Hi there</article>"), (2, None, None), (None, "u", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract_main_text(df).collect()}
    assert got == {1: ("Hi there", 8), 2: ("", 0), None: ("", 0)}
    assert html.extract_main_text(df.limit(0)).count() == 0
    assert html.extract_main_text(df.union(df)).count() == 6


def test_op2_round_trip(spark):
    path = tokens.tokenizer_path(queries.WORD_TOKENIZER)
    docs = make(spark, ODD).unionByName(make(spark, ["again"])).unionByName(make(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("bigint")))
    files = records.write_token_records(docs, path, False, 2, partitions=3)
    got = records.read_token_records(files).orderBy("start").collect()
    encoder = tokens.piece_encoder(path, False)
    texts = [("null id", None), *sorted(((t, i) for i, t in [*enumerate(ODD), (0, "again")]), key=lambda x: x[1])]
    assert [r.doc_id for r in got] == [i for _, i in texts]
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    whole = Counter(tuple(np.frombuffer(encoder.encode(t or ""), "<u4").tolist()) + (2,) for t, _ in texts)
    assert Counter(tuple(r.ids) for r in got) == whole
    mixed = records.read_token_records(files, shuffle_seed=3).collect()
    assert Counter(tuple(r.ids) for r in mixed) == whole
    assert records.read_token_records(records.write_token_records(docs.limit(0), path, False, 2)).count() == 0


def test_op2_damage_is_found():
    data = bytearray(records.frame_records([b"\x01\x00\x02\x00"]))
    assert records.open_records(bytes(data), np.zeros(1), np.array([2]), 2)[0].tolist() == [1, 2]
    data[13] ^= 1
    with pytest.raises(ValueError):
        records.open_records(bytes(data), np.zeros(1), np.array([2]), 2)


def test_op3_separates_and_covers_odd_rows(spark):
    good = [prose(i, 80) + "." for i in range(60)]
    bad = ["spam spam !!! " * 30 + str(i) for i in range(60)]
    docs = make(spark, [*good, *bad, *ODD])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 131 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.3) == (i < 60) for i in held)
    assert quality.quality_scores(docs, labels.limit(0)).filter("score = 0.5").count() == 131
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("hash_bytes", [16, 1])
def test_op4_matches_brute_force(spark, hash_bytes):
    base = prose(9, 3000)
    texts = [*ODD, base, base.upper(), base + "x", "x" + base, base]
    got = {r.doc_id: r for r in exact.exact_duplicates(make(spark, texts), sizes=(64, 128, 512), hash_bytes=hash_bytes).collect()}
    lower = [(t or "").encode().lower().decode() for t in texts]
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")) for t in texts]
    assert len(got) == len(texts) and lower == low
    for i, t in enumerate(low):
        same = [j for j, u in enumerate(low) if u == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), i == max(same))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact.exact_duplicates(make(spark, texts).limit(0)).count() == 0


def test_op5_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    base = prose(5, 120).split()
    texts = list(ODD)
    for _ in range(60):  # near copies around the threshold, so that some are linked only by others
        own = list(base)
        for at in rng.integers(0, len(own), rng.integers(0, 6)):
            own[at] = f"n{rng.integers(0, 9)}"
        texts.append(" ".join(own))
    sets = [minhash.shingle_set((t or "").encode(), 4) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r for r in minhash.near_duplicates(make(spark, texts), minhash.Settings(shingle=4)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)
    assert minhash.near_duplicates(make(spark, texts).limit(0)).count() == 0


def test_op5_pruning_keeps_true_pairs():
    enough = minhash.least_matches(minhash.Settings(miss=1e-6))
    assert enough[128] < 128 * 0.8 and enough[128] > 128 * 0.5 and (np.diff(enough) >= 0).all()


def test_op6_held_out_accuracy(spark):
    texts, langs = [], []
    for i in range(120):
        texts.append(prose(i, 30) if i % 2 else " ".join(f"żół{x}ć" for x in np.random.default_rng(i).integers(0, 50, 30)))
        langs.append("a" if i % 2 else "b")
    rows = [(i, t, g, "s", 1) for i, (t, g) in enumerate(zip(texts, langs))] + [(500, None, "a", "s", 1), (501, "12 !", None, "s", 1), (None, "w1q w2q", "a", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("gram", F.lit(1))
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == langs[i] for i in range(120))
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[500].score == 0
    assert langid.predict(docs, langid.fit(docs.limit(0))).filter("lang_pred != 'und'").count() == 0


def test_op6_grams_do_not_cross_texts():
    grams, text, has = langid.text_grams(["ab", "", "ab", "1"], 3)
    assert has.tolist() == [True, False, True, False]
    assert sorted(grams[text == 0].tolist()) == sorted(grams[text == 2].tolist())


def test_op7_pairs_and_prefixes(spark):
    rng = np.random.default_rng(8)
    texts, marks = [], []
    for i in range(300):
        one, two = rng.random(2) < 0.5
        texts.append(prose(i, 30, 50) + (" insult" if one else "") + (" groupname" if two else ""))
        marks.append(int(one and two))  # only together
    docs = make(spark, [*texts, *ODD])
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(1, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs.drop("score"), labels, epochs=40)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(marks[i]) for i in held]) > 0.95
    assert len(got) == 300 + len(ODD)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0)), ["doc_id"]).filter("score != 0.5").count() == 0


def test_op7_rare_terms(spark):
    rng = np.random.default_rng(9)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(300)]
    which = rng.integers(0, 600, 3000)  # half of the texts hold one of 300 rare words, about five times each
    docs = make(spark, [prose(i, 20, 60) + (f" {names[w]}." if w < 300 else "") for i, w in enumerate(which)])
    labels = spark.createDataFrame([(i, int(w < 300)) for i, w in enumerate(which)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()}
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == 0]
    learned = {w for i, w in enumerate(which) if i not in set(held)}
    assert np.mean([got[i] >= 0.5 for i in held if which[i] < 300 and which[i] in learned]) > 0.9
    assert np.mean([got[i] >= 0.5 for i in held if which[i] >= 300]) < 0.03


def test_op7_scores_like_all_pairs(spark):
    rng = np.random.default_rng(10)
    docs = make(spark, [prose(i, 12, 40) for i in range(40)] + ["", None, "same same", "same same"])
    buckets = []
    for row in docs.orderBy("doc_id").collect():
        text = (row.text or "").encode()
        buckets.append(toxicity._term_pairs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[1])
    terms = np.unique(np.concatenate(buckets))[::2]
    table = rng.normal(0, 0.3, (len(terms), 4)).astype(np.float32)
    model = toxicity.FactorizationMachine(terms.astype(np.int32), 0.2, table)
    got = [r.score for r in toxicity.score(docs, model, ["doc_id"]).orderBy("doc_id").collect()]
    for own, score in zip(buckets, got, strict=True):
        x = table[np.isin(terms, own)].astype(float)
        z = 0.2 + x[:, 0].sum() + sum(x[i, 1:] @ x[j, 1:] for i in range(len(x)) for j in range(i))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-6


def test_op8_matches_brute_force(spark):
    import regex

    items = [prose(100 + i, n, 5000) for i, n in enumerate([2, 3, 5, 9, 15, 16, 31, 40, 63, 70, 150])] + [None, "", "one", prose(104, 15, 5000)]
    edited = items[7].split()
    edited[20] = "changed"
    texts = [*ODD, *[f"{prose(i, 40)} {t.upper()}, {prose(i + 50, 13)}" for i, t in enumerate(items[:11])], " ".join(edited), items[5]]
    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    item_words = {i: split(t) for i, t in enumerate(items) if len(split(t)) > 1}
    spread = Counter(s for w in item_words.values() for s in shingles(w))
    weight = lambda s: math.log1p(len(item_words) / spread[s])
    expected = {}
    for d, t in enumerate(texts):
        w = split(t)
        for i, own in item_words.items():
            size = min(5, len(own))
            have = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
            got = sum(weight(s) for s in shingles(own) if s in have) / sum(weight(s) for s in shingles(own))
            if got >= 0.8:
                expected[d, i] = round(got, 6)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").withColumn("key", F.lit(1))
    rows = decontaminate.leaks(make(spark, texts), bench).collect()
    found = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in rows}
    long_enough = {k: v for k, v in expected.items() if len(item_words[k[1]]) >= 5}
    assert {k: v for k, v in found.items() if len(item_words[k[1]]) >= 5} == long_enough and len(long_enough) >= 10
    assert decontaminate.leaks(make(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.leaks(make(spark, texts), bench.limit(0)).count() == 0
    kept = decontaminate.drop_leaks(make(spark, texts), bench)
    assert kept.columns == make(spark, texts).columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in found}


def brute_leaks(texts, items):
    """(text, item) -> similarity of all pairs that reach 0.8, over whole texts and items of any length."""
    import regex

    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    own = {i: runs(split(t), min(5, len(split(t)))) for i, t in enumerate(items) if split(t)}
    spread = Counter(s for have in own.values() for s in have)
    weight = {s: math.log1p(len(own) / n) for s, n in spread.items()}
    expected = {}
    for d, t in enumerate(texts):
        have = {n: runs(split(t), n) for n in range(1, 6)}
        for i, mine in own.items():
            got = sum(weight[s] for s in mine & have[len(next(iter(mine)))]) / sum(weight[s] for s in mine)
            if got >= 0.8 - 1e-9:
                expected[d, i] = round(got, 6)
    return expected


def edited_leaks(seed, n_items, copies):
    """Items of 15 to 59 words, and texts that hold them with 1 to 4 random edits at every alignment."""
    rng = np.random.default_rng(seed)
    items = [prose(1000 * seed + i, int(rng.integers(15, 60)), 5000) for i in range(n_items)]
    texts = []
    for i in range(n_items * copies):
        own = items[i % n_items].split()
        for _ in range(1 + i % 4):
            at, kind = rng.integers(len(own)), rng.integers(4)
            own[at : at + (kind < 3)] = [f"n{rng.integers(99)}"] if kind != 1 else []
        texts.append(" ".join([prose(10**6 + i, 30 + i // 4 % 8, 5000), *own, prose(2 * 10**6 + i, 20, 5000)]))
    return items, texts


def test_op8_finds_every_edited_leak(spark):
    items, texts = edited_leaks(3, 24, 16)
    expected = brute_leaks(texts, items)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = decontaminate.leaks(make(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in rows} == expected and len(expected) > 100


def test_op8_finds_short_items_inside_longer_texts(spark):
    items = [*[prose(200 + i, n, 5000) for i, n in enumerate([1, 2, 3, 4, 5, 6, 30])], "", None]
    texts = [*ODD, *[f"{prose(i, 40)} {t}, {prose(i + 50, 13)}" for i, t in enumerate(items[:7])], items[0], items[2], " ".join(items[3].split()[:3])]
    expected = brute_leaks(texts, items)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = decontaminate.leaks(make(spark, texts), bench, least_words=1).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in rows} == expected and len(expected) >= 9
    rows = decontaminate.leaks(make(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {k for k in expected if k[1] != 0}


def test_pipeline_drops_the_leaks_that_brute_force_finds(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").collect()
    leaked = {rows[d].doc_id for d, _ in brute_leaks([r.text for r in rows], [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])}
    kept = {r.doc_id for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in rows} - leaked and leaked


def test_op9_packs_without_gaps(spark):
    docs = make(spark, [*ODD, *[prose(i, 20 + 7 * i) for i in range(80)]])
    pieces = packing.token_pieces(docs, tokens.tokenizer_path(queries.BYTE_TOKENIZER), True, 0, 64)
    rows = packing.pack_pieces(pieces, 64, group_items=50).orderBy("sequence_id", "offset").collect()
    fill, docs_seen = Counter(), Counter()
    for r in rows:
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
        docs_seen[r.doc_id] += r.length
    assert max(fill.values()) <= 64 and len(docs_seen) == 91
    assert len(fill) <= 1.03 * sum(fill.values()) / 64 + 1
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == by_doc.get(r.doc_id, 0)
        assert r.piece == 0 or r.length == 64
        by_doc[r.doc_id] = r.start + r.length
    assert packing.pack_pieces(pieces.limit(0), 64).count() == 0


def plain_sum_of_squares(lengths, capacity):
    """Fills in order of opening, trying every open sequence and counting all gaps anew."""
    fills, chosen = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        best = None
        for b, fill in enumerate(fills):
            if fill + lengths[i] <= capacity and fill < capacity:
                after = fills[:b] + [fill + lengths[i]] + fills[b + 1 :]
                squares = sum(c * c for c in Counter(capacity - f for f in after if f < capacity).values())
                if best is None or (squares, -fill) < best[:2]:
                    best = (squares, -fill, b)
        if best is None:
            fills.append(0)
            best = (0, 0, len(fills) - 1)
        chosen.append(-best[1])
        fills[best[2]] += lengths[i]
    return sorted(fills), chosen


def best_fit_count(lengths, capacity):
    fills = []
    for size in sorted(lengths.tolist(), reverse=True):
        room = [(f, b) for b, f in enumerate(fills) if f + size <= capacity]
        if room:
            fills[max(room)[1]] += size
        else:
            fills.append(size)
    return len(fills)


def test_op9_least_squares_group():
    for seed, most, n in ((1, 64, 120), (2, 12, 150), (3, 3, 60)):
        lengths = np.random.default_rng(seed).integers(1, most + 1, n)
        bins, at = packing.pack_group(lengths, 64)
        fills, chosen = plain_sum_of_squares(lengths.tolist(), 64)
        assert sorted(np.bincount(bins, lengths).astype(int)) == fills
        assert at[np.argsort(-lengths, kind="stable")].tolist() == chosen
    rng = np.random.default_rng(4)
    short = np.minimum(rng.lognormal(6, 0.8, 4000).astype(int) + 1, 2047)  # like texts' lengths
    bins, _ = packing.pack_group(short, 2048)
    assert bins.max() + 1 <= 1.01 * short.sum() / 2048 + 1
    lengths = rng.integers(1, 2049, 4000)
    bins, _ = packing.pack_group(lengths, 2048)
    assert bins.max() + 1 <= 1.005 * best_fit_count(lengths, 2048)
    assert packing.pack_group(np.zeros(0, np.int64), 64)[0].tolist() == []


def test_op9_crc_of_pieces(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, *[prose(i, 30 + 9 * i) for i in range(30)]]
    path = tokens.tokenizer_path(queries.BYTE_TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    expected = []
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        expected += [(p, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())) for p, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    rows = packing.pack_pieces(packing.token_pieces(make(spark, texts), path, True, 0, 64), 64).collect()
    assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)


@pytest.mark.parametrize("part_bytes", [1 << 20, 8])
def test_op10_exact_parts_and_model(spark, part_bytes):
    texts = [*ODD, *[" ".join(f"w{(k * 7) % 90}" for k in range(i, i + 60)) for i in range(60)]]
    got = {r.doc_id: r for r in lm.language_model_scores(make(spark, texts), id_remainder(7) != 2, part_bytes=part_bytes).collect()}
    tokens_of = [(t or "").encode().lower().split() + [None] for t in texts]
    trained = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    count = Counter(w for own, use in zip(tokens_of, trained) if use for w in own)
    n, v = sum(count.values()), len(count)
    assert len(got) == len(texts)
    for i, own in enumerate(tokens_of):
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        r = got[i]
        assert r.base_score == pytest.approx(base, abs=1e-9 * max(1, abs(base))) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(own), sum(count[w] > 0 for w in own))
    regular = [i for i in range(len(ODD), len(texts)) if not trained[i]]
    assert sum(got[i].score for i in regular) > sum(got[i].base_score for i in regular)
    assert lm.language_model_scores(make(spark, texts).limit(0), id_remainder(7) != 2).count() == 0


def test_op10_both_ways_give_the_model_of_plain_counts(spark):
    """``score`` against counts kept in a dict: false positives of the filter can only raise it, a little."""
    texts = [*ODD, *[prose(k, 80, 60) for k in range(40)]]
    docs = make(spark, texts).unionByName(make(spark, [prose(1), None, "w1q"]).withColumn("doc_id", F.lit(None).cast("bigint")))
    use = id_remainder(7) != 2
    both = [
        sorted(lm.language_model_scores(docs, use, part_bytes=size).collect(), key=str) for size in (1 << 20, 8)
    ]
    assert [tuple(r) for r in both[0]] == [tuple(r) for r in both[1]] and len(both[0]) == len(texts) + 3
    tokens_of = [(t or "").encode().lower().split() + [None] for t in texts]
    trained = [own for i, own in enumerate(tokens_of) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for own in trained for w in own)
    pairs = Counter(p for own in trained for p in zip([None, *own], own))
    n, v = sum(count.values()), len(count)
    raised = []
    for i, own in enumerate(tokens_of):
        total = 0.0
        for a, b in zip([None, *own], own):
            share = (count[b] + 1) / (n + v + 1)
            level = pairs[a, b].bit_length()
            found = min(1.5 * 2 ** (level - 1) - 0.5, count[a], count[b]) if level else 0.0
            total += math.log10(share * (1 + found / (1000 * share)) * 1000 / (count[a] + 1000))
        got = next(r.score for r in both[0] if r.doc_id == i)
        assert got >= total - 1e-6 * max(1, abs(total))
        raised.append((got - total) / len(own))
    assert np.mean(raised) < 0.03 and np.mean(np.array(raised) < 1e-9) > 0.1


def test_op10_counts_come_back_level_by_level(spark):
    docs = make(spark, ["a b " * 9 + "c"])
    batches = lm.token_batches(docs, F.lit(True))
    slices = [tuple(r) for r in lm.pair_slices(batches, 0).collect()]
    row = batches.collect()[0].asDict()
    places, hashes = lm._tokens(row), lm._unpack(row["hashes"])
    keys = lm._pair_keys(hashes, places, np.array(row["lengths"]))
    counts = lm.PairFilter([x[:2] for x in slices], slices[0][2], 0).counts(keys)
    assert counts[1] == 11.5 and counts[2] == 11.5  # 9 and 8: the level from 8 to 15
    assert counts[0] == 1 and counts[-1] == 1


def test_pipeline_on_small_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in out}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns
    rows = {r.doc_id: r.text or "" for r in clean.collect()}
    last = {}
    for i, t in sorted(rows.items()):
        last[t.encode().lower()] = i
    rest = {i: rows[i] for i in last.values()}
    sets = {i: minhash.shingle_set(t.encode(), 5) for i, t in rest.items()}
    for i in kept:
        for j in kept:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                assert 100 * common < 80 * (len(sets[i]) + len(sets[j]) - common)
    leaked = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert kept <= set(rest) - leaked and len(kept) > 0.5 * len(rows)
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048
