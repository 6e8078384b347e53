"""The ten operators against brute force, exact round trips or known truths, with nulls, empty tables and clashing columns."""

import gzip
import hashlib
import io
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from scholium.llm import bpe, decontaminate, htmltext, langid, licenses, linededup, media, simhash, toxicity, warc

WORDS = "the of and thing reth erst onan wheth ration inth blely andor hati esther nd ing".split()
EDGE = [(900, None), (901, ""), (902, "   \n\t "), (None, "no id here at all"), (903, "x" * 5000), (904, "É日本 ½ \x00 z")]


def texts(n, seed=1, size=60):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, size)))) for i in range(n)]


def frame(spark, rows, schema="doc_id long, text string"):
    # A clashing column of another meaning must not disturb.
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumn("score", F.lit("clash")).withColumn("component_id", F.lit(-1)).withColumn("row", F.lit(0))


def test_simhash_equals_brute_force(spark):
    rows = texts(120, 3, 12) + [(200 + i, t) for i, (_, t) in enumerate(texts(60, 3, 12))] + EDGE
    got = simhash.query(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {i: simhash.fingerprint(t)[0][0] for i, t in rows if i is not None}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if label[b] < label[a] and (fps[a] ^ fps[b]).bit_count() <= 2:
                    label[a], changed = label[b], True
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == label
    assert {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] is not None} == {i: f"{x:016x}" for i, x in fps.items()}
    assert simhash.query(frame(spark, [])).count() == 0


def test_near_duplicates_keep_one_of_each_class(spark):
    base = " ".join(f"w{i}" for i in range(300))
    edited = base.replace(" w150 ", " other ")
    rows = [(5, base), (7, edited), (9, base), (11, " ".join(f"v{i}" for i in range(300))), (None, base)]
    got = simhash.one_of_each(frame(spark, rows)).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == [-1, 5, 11]


def test_near_duplicates_have_exactly_the_similarity(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = [(1, "a b c d e f g h i"), (2, "a b c d e f g h")]  # sets of 5 and 4 shingles: just 0.8
    for k in range(60):
        base = [word() for _ in range(104)]
        rows += [(1000 + 10 * k, " ".join(base)), (1001 + 10 * k, " ".join(base[:50] + [word(), word()] + base[52:] if k % 2 else base[:-11] + [word() for _ in range(11)]))]
        rows += [(1002 + 10 * k, " ".join([word() for _ in range(14)] + base[14:]))]
    loop = [word() for _ in range(6)]
    rows += [(5000, " ".join(loop * 30)), (5001, " ".join(loop * 10)), (5002, " ".join(loop * 30 + [word() for _ in range(9)]))]
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(frame(spark, rows), tile=16, small=8).collect()}
    assert got == label and label[2] == 1 and len(set(label.values())) < len(label)


def test_tiles_lose_no_link():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40).astype(np.int64)
    near = np.array([b ^ (1 << int(k)) ^ (1 << int(m)) for b in base for k, m in r.integers(0, 63, (4, 2))], np.int64)
    rows = np.concatenate([base, near])
    tile = np.stack([np.arange(len(rows)), rows], 1)
    links = simhash.compared(tile[:90], tile[90:], 2)
    assert {int(b) for _, b in links} | {int(a) for a, _ in links} >= set(range(90, 200)) - set(range(40, 90))


def test_bpe_equals_the_library(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    r = random.Random(2)
    rows = [*EDGE[:-1], *texts(40), (910, "THE ΣΑΣ İ ½ don't WE'LL <|endoftext|> x"), (911, "".join(r.choice("thaninger") for _ in range(4000))), (912, "日本語 ٣ é ﬁ")]
    got = {r["doc_id"]: r for r in bpe.query(frame(spark, rows)).collect()}
    for i, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    whole = {r["doc_id"]: r["decoded"] for r in bpe.encoded(frame(spark, [(1, "Hello  wörld")]), path).collect()}
    assert whole == {1: "hello wörld "}


def test_line_dedup_keeps_the_first_and_counts_exactly(spark):
    rows = [(i, f"s{i}", f"own {i}\nshared line\nnearly {i % 3}") for i in range(12)] + [(50, "s1", "shared line"), (51, None, None), (52, "s2", ""), (None, "s3", "shared line")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in linededup.cleaned(docs, 10).collect()}
    assert got[0]["text"] == "own 0\nshared line\nnearly 0" and got[3]["text"] == "own 3\nnearly 0"
    assert got[50]["text"] == "" and got[51]["text"] is None and got[None]["text"] == "shared line"
    assert linededup.cleaned(docs, 13).where("lines_removed > 0").count() == 0
    assert linededup.cleaned(docs, 12).where("lines_removed > 0").count() == 12
    assert linededup.cleaned(docs.limit(0)).count() == 0


def test_license_places(spark):
    cases = [(1, "Released under the MIT License. under the mit license"), (2, "Apache License, Version 2.0; CC BY-NC"), (3, "This is licensed under the GNU General Public License, version 3"), (4, "mit license under the"), *EDGE]
    got = {r["doc_id"]: r for r in licenses.query(frame(spark, cases)).collect()}
    for i, text in cases:
        n, places, labels = licenses.places_by_hand(text)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(places), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((places[0], places[-1]) if places else (None, None))
    assert got[3]["labels"] == "gpl-3" and got[1]["labels"] == "mit" and got[1]["score"] == 1 and got[4]["score"] == got[900]["score"] == got[901]["score"] == 0
    assert licenses.query(frame(spark, [])).count() == 0


def test_license_labels_equal_brute_force(spark):
    r = random.Random(12)
    cases = []
    for i in range(80):
        words = [r.choice(WORDS) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            _, text, key = r.choice(licenses.TEMPLATES)
            piece = r.choice([text.split(), text.split(), key.split(), text.split()[: r.randint(3, 30)]])
            piece = [w if r.random() > 0.15 else r.choice(WORDS) for w in piece] if r.random() < 0.4 else piece
            at = r.randint(0, len(words))
            words[at:at] = piece
        cases.append((i, " ".join(words).title() if i % 3 else " ".join(words)))
    cases += EDGE + [(0, cases[0][1])]
    got = licenses.query(frame(spark, cases)).collect()
    hand = licenses.labels_by_hand([t for _, t in cases])
    base = [licenses.places_by_hand(t)[2] for _, t in cases]
    want = [set(h) | set(b) for h, b in zip(hand, base)]
    score = [1 if b else round(max(h.values(), default=0), 6) for h, b in zip(hand, base)]
    assert sorted((str(i), ",".join(sorted(w)), s) for (i, _), w, s in zip(cases, want, score)) == sorted((str(x["doc_id"]), x["labels"], round(x["score"], 6)) for x in got)
    assert any(len(w) > 1 for w in want) and any(not w for w in want)


def test_licenses_need_more_than_the_key_phrase(spark):
    r = random.Random(4)
    said = ["we often discuss the mit license here", "the apache license of that project", "permission is hereby granted free of charge to enter the park", "the gnu general public license version 3", "hello world", None]
    whole = [(label, text) for label, text, _ in licenses.TEMPLATES if len(text.split()) > 20]
    edited = []
    for (_, text), (_, _, key) in zip(whole, [t for t in licenses.TEMPLATES if len(t[1].split()) > 20]):
        words, start = text.split(), text.split().index(key.split()[0])
        for _ in range(2):
            words[r.choice([p for p in range(len(words)) if not start - 3 <= p < start + 20] or [len(words) - 1])] = "thing"
        edited.append(" ".join(words) + " and so on")
    rows = list(enumerate([*said, *(t for _, t in whole), *edited]))
    got = {x["doc_id"]: x for x in licenses.query(frame(spark, rows)).collect()}
    assert all(got[k]["labels"] == "" and got[k]["score"] == 0 for k in range(len(said)))
    for k, (label, _) in enumerate(whole):
        assert label in got[len(said) + k]["labels"].split(",") and got[len(said) + k]["score"] == 1
        assert label in got[len(said) + len(whole) + k]["labels"].split(",") and got[len(said) + len(whole) + k]["score"] >= 0.5


def test_line_dedup_keeps_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"s{i % 15}", f"same line\nown {i}\n") for i in range(40)] + [(None, "s1", "same line\nx"), (50, None, None), (3, "s3", "same line\nown 3\n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"line_keys": F.lit("k"), "Lines_Removed": F.lit("mine"), "line_owner": F.lit(9), "h": F.lit(1)})
    got = linededup.cleaned(docs)
    assert got.columns == [*docs.columns, "lines_removed_"]
    out = got.collect()
    assert len(out) == len(rows) and all(x["Lines_Removed"] == "mine" and x["line_keys"] == "k" and x["line_owner"] == 9 for x in out)
    assert {x["doc_id"]: x["lines_removed_"] for x in out} == {**{i: int(i > 0) for i in range(40)}, None: 0, 50: 0}
    assert linededup.cleaned(docs.limit(0)).count() == 0


def test_language_learning_is_bounded_and_whole(spark):
    from pyspark.sql import functions as F

    pieces = sorted({w[i:j] for w in WORDS for i in range(len(w)) for j in range(i + 1, len(w) + 1)} | {"▁"})
    r = random.Random(3)
    make = lambda k: "".join(r.choice("abcde" if k else "vwxyz") for _ in range(5))
    rows = [(None, " ".join(make(k) for _ in range(8)), f"l{k}") for k in (0, 1) for _ in range(300)] + [(None, "vw xy " * 9, "l0")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logp = langid.learn(docs, pieces, docs_per_lang=50)
    assert langs == ["l0", "l1"] and logp.shape == (len(pieces) + 1, 2)
    out = langid.predict(docs, pieces, langs, logp)
    assert out.count() == len(rows) and out.where("doc_id is not null").count() == 0
    with pytest.raises(ValueError):
        langid.learn(docs, pieces, max_langs=1)
    assert langid.accepted(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("h", F.lit(1)), pieces=pieces).count() == len(rows)
    long = spark.createDataFrame([(1, "ab" * 200, "l1"), (2, "x" * 3, "l0")], "doc_id long, text string, lang string")
    langs, logp = langid.learn(long, ["a", "ab", "b", "▁a"])
    assert logp[1:3, 1].max() > logp[1:3, 0].max()


def test_licenses_keep_the_labels_of_each_notice(spark):
    notices = [(label, text) for label, text, _ in licenses.TEMPLATES]
    alone = {x["doc_id"]: set(x["labels"].split(",")) for x in licenses.query(frame(spark, list(enumerate(t for _, t in notices)))).collect()}
    assert all(label in alone[k] for k, (label, _) in enumerate(notices))
    pairs = [(i, j) for i in range(len(notices)) for j in range(len(notices)) if i != j]
    rows = [(100 * i + j, f"{notices[i][1]}\n\nalso: {notices[j][1]}") for i, j in pairs]
    got = {x["doc_id"]: set(x["labels"].split(",")) for x in licenses.query(frame(spark, rows)).collect()}
    assert not [(i, j) for i, j in pairs if not alone[i] | alone[j] <= got[100 * i + j]]
    apart = "Permission is hereby granted, free of charge. Files, documentation: associated software; copy obtaining person"
    rows = [(0, apart)] + [(k, "permission hereby granted free charge") for k in range(1, 30)]
    assert {x["doc_id"]: x["labels"] for x in licenses.query(frame(spark, rows)).collect()}[0] == ""  # the key phrase, and the notice's words elsewhere


def test_warc_round_trip(spark):
    big = "é" * 1_500_000
    rows = [(1, "http://a/ b", "x" * 1000), (2, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", big), (7, "u", "WARC/1.1\r\n\r\n" * 9), (None, "u", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.query(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3, 4)] == [("revisit", 2), ("response", None), ("response", None), ("response", None)]
    chunks = [(c[3], c[4]) for c in warc.parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(b"".join(warc.records(6, "u", big.encode(), None))))), False)]
    assert [k for k, _ in chunks] == list(range(len(chunks))) and max(n for _, n in chunks) <= warc.CHUNK
    assert warc.query(pages.limit(0)).count() == 0


def test_media_round_trip(spark):
    rows = [*texts(30), (100, "same"), (101, "same"), *EDGE, (905, "long " * 400_000)]
    got = media.query(frame(spark, rows)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[100][2:] == by[101][2:]
    index = media.addressed(media.store(frame(spark, rows[:5]), media.new_path(spark, "t")))
    assert all(r["width"] == 64 and r["height"] * 64 >= r["n_bytes"] for r in media.metadata(index).collect())


def test_decontamination(spark):
    assert tuple(decontaminate.masks_for()) == decontaminate.MASKS
    item = [f"q{i}" for i in range(30)]
    broken = [w if i % 6 else "zz" for i, w in enumerate(item)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "a b c d"), (3, "five short words of test"), (4, None)], "item_id long, text string")
    rows = [(1, "intro " + " ".join(item).upper() + " end"), (2, "x " + ", ".join(broken)), (3, " ".join(item[:12])), (4, "a b c d"), (5, "so: five short words of test."), (6, " ".join(w if i % 3 else "zz" for i, w in enumerate(item))), *EDGE]
    rows.append((7, "pad " * 700_000 + " ".join(item)))
    # Across the border of two pieces, once with a substituted word longer than any overlap in bytes.
    rows.append((8, "pad " * ((1 << 19) - 10) + " ".join(item) + " pad" * 20_000))
    rows.append((9, "pad " * ((1 << 19) - 14) + " ".join([*item[:15], "g" * 100_000, *item[16:]]) + " pad" * 20_000))
    rows.append((10, "\n".join(" ".join(item[:22]) for _ in range(3000))))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.query(frame(spark, rows), items).collect()}
    assert got == {(1, 1), (2, 1), (5, 3), (7, 1), (8, 1), (9, 1), (10, 1)}
    kept = {r["doc_id"] for r in decontaminate.clean(frame(spark, rows), items).collect()}
    assert kept == {i for i, _ in rows} - {1, 2, 5, 7, 8, 9, 10}


def test_common_seed_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HEAVY", 8)
    item = lambda i: "in the middle of a " + " ".join(f"i{i}w{k}" for k in range(15))
    items = spark.createDataFrame([(i, item(i)) for i in range(50)], "item_id long, text string")
    rows = [(d, f"d{d} in the middle of a place " + (item(d) if d < 30 else f"x{d}")) for d in range(200)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.query(frame(spark, rows), items).collect()}
    assert got == {(d, d) for d in range(30)}
    hits = spark.createDataFrame([(r, 7 if r % 3 else r, 0) for r in range(300)], "region long, h long, at int")
    seeds = spark.createDataFrame([(7 if i < 60 else i, i, 0, 20) for i in range(90)], "h long, item_id long, place int, n int")
    left, right = decontaminate.dealt(hits, seeds, 300, 90)
    pairs = lambda a, b, on: sorted(map(tuple, a.join(b, on).select("region", "item_id").collect()))
    assert pairs(left, right, ["h", "left", "right"]) == pairs(hits, seeds, "h")
    for side in (left, right):
        assert max(r["count"] for r in side.groupBy("h", "left", "right").count().collect()) < 24


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "a", "b", "ab", "▁ab", "▁"]
    p = np.random.default_rng(1).dirichlet(np.ones(7), 2).T
    lattice = langid.Lattice(pieces, np.log(p))

    def brute(word):
        total = np.zeros(2)
        for mask in range(1 << (len(word) - 1)):
            parts, start = [], 0
            for k in range(len(word)):
                if k == len(word) - 1 or mask >> k & 1:
                    parts.append(word[start : k + 1])
                    start = k + 1
            rows = [lattice.number.get(x, 0 if len(x) == 1 else None) for x in parts]
            if None not in rows:
                total += np.prod(p[rows], 0)
        return np.log(total)

    for word in ("▁ab", "▁abab", "▁ba?b"):
        assert np.allclose(lattice.log_likelihood([word])[0], brute(word))
        assert np.allclose(lattice.long(word), brute(word))


def test_language_id_held_out(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    edge = langid.query(docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(900, None, "en"), (901, "12 + 3!", None)], "doc_id long, text string, lang string")))
    assert {r["lang_pred"] for r in edge.where("doc_id >= 900").collect()} == {"und"}
    assert langid.query(docs.limit(0)).count() == 0


def test_toxicity_finds_the_marked_words(spark):
    r = random.Random(4)
    bad = ["vilest", "scumword", "wretched"]
    rows, labels = [], []
    for i in range(400):
        words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(r.randint(10, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randint(0, len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = frame(spark, rows + EDGE), spark.createDataFrame([*labels, (902, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.query(docs, known).collect()}
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == dict(labels)[i] for i in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(rows) + len(EDGE)
    assert toxicity.query(docs, known.limit(0)).where("score <> 0").count() == 0


def same_words(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


PROSE = [
    "The committee met on Tuesday, and after a long debate it agreed to publish the report in full, with all of its annexes.",
    "Several speakers, among them two former ministers, argued that the costs had been understated. Others disagreed, and said so.",
] * 4
LINKS = "".join(f'<div class="x{i}"><a href="/{i}">Link {i}</a></div>' for i in range(8))
PARAS = "".join(f"<p>{p}</p>" for p in PROSE)
LAYOUTS = {
    "hashed names": f'<div class="a1b"><div class="zz9">{LINKS}</div></div><div class="k3"><div class="q9z">{PARAS}</div></div><div class="m2">{LINKS}<span>Copyright</span></div>',
    "no names": f"<div>{LINKS}</div><div><div>{PARAS}</div></div><div>{LINKS}</div>",
    "table": f"<table><tr><td>{LINKS}</td><td>{PARAS}</td></tr><tr><td colspan=2>Copyright</td></tr></table>",
    "table and breaks": f"<table><tr><td>{LINKS}</td><td>{'<br><br>'.join(PROSE)}</td></tr></table>",
    "boxes for paragraphs": f'<div class="qq">{LINKS}</div><div class="r7"><div class="r8">{"".join(f"<div>{p}</div>" for p in PROSE)}</div></div>',
    "paragraphs only": PARAS,
    "unnamed section": f"<header><a href=/>Home</a></header><section>{PARAS}</section><footer>Copyright</footer>",
    "comments": f'<div class=content>{PARAS}</div><div class=comments><h3>Comments</h3><div class=comment><p>{PROSE[1]}</p></div></div>',
    "links in the text": f'<div class="z8"><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></div><div class="w0">{"".join(f"<p>{p[:60]}<a href=x>{p[60:90]}</a>{p[90:]}</p>" for p in PROSE)}</div>',
}


def test_html_extraction_on_held_out_layouts(spark):
    trees = htmltext.learn(spark)

    def text_of(page, kept):
        return htmltext.text_of(page, kept)

    shares = []
    for k in range(60):
        page = htmltext.parse(htmltext.generated(10**9 + k))
        kept = htmltext.decoded(page, trees.odds(htmltext.features(page)))
        truth = [True] + [n.label == 1 for n in page.nodes[1:]]
        for i in range(1, len(truth)):
            truth[i] = truth[i] and truth[page.nodes[i].parent]
        shares.append(same_words(text_of(page, kept), text_of(page, truth)))
        assert all(kept[page.nodes[i].parent] or not kept[i] for i in range(1, len(kept)))
    assert sum(shares) / len(shares) >= 0.95
    for name, body in LAYOUTS.items():
        page = htmltext.parse(f"<html><body>{body}</body></html>")
        assert same_words(text_of(page, htmltext.decoded(page, trees.odds(htmltext.features(page)))), " ".join(PROSE)) >= 0.95, name
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    edge = spark.createDataFrame([(900, None, None), (901, "u", ""), (902, "u", "<p>a &amp b<br>c<p>d"), (903, "u", "<" * 50), (904, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in htmltext.extract(pages.unionByName(edge), trees).collect()}
    assert got[900]["text"] == got[901]["text"] == ""
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = re.split(r"<[^>]+>", re.sub(r"</?b>", "", inner))
        assert got[r["page_id"]]["text"] == re.sub(r"\s+", " ", " ".join(map(htmltext.html.unescape, blocks))).strip()
    # Columns of clashing names, repeated rows, rows without an id, an empty table.
    clash = spark.createDataFrame([(1, "u", PARAS, "x", 5), (1, "u", PARAS, "y", 6), (None, "v", PARAS, None, 7)], "page_id long, url string, html string, text string, n_chars int")
    rows = htmltext.extract(clash, trees).collect()
    assert len(rows) == 3 and len({r["text"] for r in rows}) == 1 and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    assert htmltext.extract(clash.limit(0), trees).count() == 0


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a \"<a '" * 100_000, "<b>" * 100_000 + "</i>" * 100_000 + "</div>" * 100_000, "<ul>" + "<div>" * 30_000 + "<li></li>" * 30_000, "<div>" + "<i>" * 50_000 + "<hr>" * 50_000, "<u><div>" + "<i>" * 50_000 + "</u>" * 50_000])
def test_parser_is_linear(page):
    began = time.process_time()
    htmltext.parse(page)
    assert time.process_time() - began < 10


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() <= n
        n = docs.count()
    assert 0 < n < 200
