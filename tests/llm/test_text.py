from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from furrow.llm import bpe, fingerprints, html_text, license_texts, licenses, lm_scoring, mixing, secrets, toxicity

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


TEXTS = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def library_row(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def test_bpe_equals_the_library(spark, odd, nothing, library):
    for d in (documents(spark), odd):
        text = {r.doc_id: r.text for r in d.collect()}
        got = bpe.encode_documents(d).collect()
        assert len(got) == d.count()
        assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == library_row(library, text[r.doc_id]) for r in got)
    assert bpe.encode_documents(nothing).count() == 0


def test_bpe_streams_long_words_and_decodes(spark, library):
    own, r = bpe.load(bpe.default_path()), random.Random(3)
    for n in (50, 3000, 9000):
        w = "".join(r.choice(["the", "ing", "an", "qu", "tion", "z", "e"]) for _ in range(n))
        raw = w.encode()
        assert list(own.transduce(raw[i : i + 97] for i in range(0, len(raw), 97))) == library.encode(w, add_special_tokens=False).ids
    odd_texts = ["ΑΣ ΣΑΣ İx", "a\x1cb c\x85d᠎e​f", "é ﬁ ß K", "don't we'll 123 _--", "<|startoftext|>a<|endoftext|>"]
    assert all(list(own.encode(t)) == library.encode(t, add_special_tokens=False).ids for t in odd_texts)
    d = spark.createDataFrame([(1, "grüße an alle , 日本 !"), (2, None)], "doc_id long, text string")
    assert {x.doc_id: x.text for x in bpe.decode_ids(bpe.encode_ids(d)).collect()} == {1: "grüße an alle , 日本 ! ", 2: ""}


def test_bpe_emits_inside_ordinary_words():
    own, r = bpe.load(bpe.default_path()), random.Random(8)
    words = {w for t in bpe.normalised(" ".join(x or "" for x in TEXTS)) for w in t if w.isalpha() and len(w) > bpe.READ}
    drawn = ["".join(r.choices(letters, k=r.randint(1, 400))) for letters in ("abcdeinrst", "ah", "éß日!-=_") for _ in range(150)]
    early = late = 0
    for w in [*words, *drawn, *(c * n for c in "a-=" for n in (5, 60, 3000))]:
        raw, ended = w.encode(), []

        def fed(raw=raw, ended=ended):
            for i in range(0, len(raw), 4):
                yield raw[i : i + 4]
            ended.append(True)

        got = []
        for t in own.transduce(fed()):
            got.append(t)
            if w in words:
                early, late = early + (not ended), late + bool(ended)
        assert got == own.merge([*(own.inner[b] for b in raw[:-1]), own.last[raw[-1]]]), w
    assert len(words) > 20
    assert early > 0.1 * (early + late)


def test_lm_counts_and_base_scores(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 500)
    for d in (documents(spark), odd):
        rows = [(r.doc_id, r.text) for r in d.collect()]
        tokens = lambda t: [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
        kept = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 10
        c = Counter(x for i, t in rows if kept(i) for x in tokens(t))
        n, v = sum(c.values()), len(c)
        want = {i: (not kept(i), len(k := tokens(t)), sum(c[x] > 0 for x in k), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in k)) for i, t in rows}
        got = lm_scoring.score_documents(d).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
            assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
            assert r.score < 0
    assert lm_scoring.score_documents(nothing).count() == 0


def test_log_frequency_filter_gives_counts_rounded_down(spark):
    d = spark.createDataFrame([("a b " * 40,), ("c d",), ("c d",), ("e f",)], "text string")
    model, _ = lm_scoring.train(d)
    toks, at = lm_scoring.token_hashes(*lm_scoring.utf8_buffers(lm_scoring.pa.array(["a b", "c d", "e f", "b c"])))
    keys = lm_scoring.bigrams(toks, at)
    assert model.grams.counts(keys).tolist() == [0, 32, 0, 0, 2, 2, 0, 0, 0, 0, 0, 0]


def test_lm_scores_do_not_depend_on_what_is_sent(spark, odd, monkeypatch):
    for d in (documents(spark), odd):
        key = lambda r: (r.doc_id or -1, r.held_out, r.n_tokens, r.score)
        whole = sorted(lm_scoring.score_documents(d).collect(), key=key)
        for name, most in (("HEAD_WORDS", 5), ("FILTER_BYTES", 16)):
            with monkeypatch.context() as m:
                m.setattr(lm_scoring, name, most)
                got = sorted(lm_scoring.score_documents(d.repartition(3)).collect(), key=key)
            assert [r[:5] for r in got] == [r[:5] for r in whole]
            assert all(math.isclose(x, y, rel_tol=1e-9) for a, b in zip(got, whole) for x, y in zip(a[5:], b[5:]))


def xx(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v & (2**64 - 1)).to_bytes(8, "little")
        seed = xxhash.xxh64(raw, seed).intdigest()
    return seed


def sketch_of(text, k=128):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    h = [xx(x) for x in w]
    if len(w) >= 5:
        s = {xx(*h[i : i + 5]) >> 16 for i in range(len(w) - 4)}
    else:
        s = {None} if w else set()
    return s, sorted(x for x in s if x is not None)[:k]


def test_fingerprints_against_brute_force(spark, odd, nothing):
    d = documents(spark)
    rows = sorted((r.doc_id, r.text or "") for r in d.collect())
    got = {r.doc_id: r for r in fingerprints.fingerprints(d).collect()}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        (s, low), (e, _) = sketch_of(t), sketch_of(edited)
        if len(re.findall(r"[^\x20\x09-\x0D]+", t)) >= 5:
            assert r.fingerprint == "".join(f"{x:012x}" for x in low)
            if None not in e:
                assert abs(r.near_edited - len(s & e) / len(s | e)) < 0.25
    odd_rows = fingerprints.fingerprints(odd).collect()
    assert len(odd_rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in odd_rows)
    assert fingerprints.fingerprints(nothing).count() == 0


def test_next_row_crosses_spans(spark):
    ids = [-5000, -1, 0, 1023, 1024, 5_000_000, 5_000_001, 9_000_000_000]
    d = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(d).collect()}
    assert got == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1])}


def test_sketches_merge(spark):
    a, b = "a b c d e f g h", "e f g h i j k l m"
    row = spark.range(1).select(
        fingerprints.sketch(F.lit(a)).alias("a"), fingerprints.sketch(F.lit(b)).alias("b"), fingerprints.distinct_count(fingerprints.sketch(F.lit(a))).alias("n")
    )
    row = row.select("*", fingerprints.merge(F.col("a"), F.col("b")).alias("m"), fingerprints.containment(F.col("a"), F.col("a")).alias("c")).first()
    assert row.m == sorted({*row.a, *row.b}) and row.n == 4 and row.c == 1


def test_licenses_on_odd_rows(odd, nothing):
    got = {r.doc_id: (r.n_matches, r.licenses) for r in licenses.scan_licenses(odd).collect()}
    assert got[12] == (1, "mit") and got[1] == (0, "") and got[4] == (0, "")
    assert licenses.scan_licenses(nothing).count() == 0


def test_whole_licenses_inside_documents(spark, odd, nothing):
    known = {(n, len(t) > 2000 or n in ("mit", "bsd-2-clause", "bsd-3-clause")): t for n, t in license_texts.templates()}
    flat = lambda t: " ".join(t.split())
    before, after = "Some words of its own. And more of them.\n", "\nThe end of it; no more."
    mit, bsd, gpl, apache = known["mit", True], known["bsd-3-clause", True], known["gpl-3.0", False], known["apache-2.0", True]
    rows = [
        (1, before + mit + after, (1, "mit")), (2, before + flat(mit) + after, (1, "mit")), (3, before + flat(bsd).replace("copyright holder", "Example Corp") + after, (1, "bsd-3-clause")),
        (4, before + gpl + before + mit, (2, "gpl-3.0,mit")), (5, apache, (1, "apache-2.0")), (6, mit[: len(mit) // 2], (0, "")), (7, (mit + "\n") * 3, (1, "mit")), (8, flat(known["lgpl-2.1", False]), (1, "lgpl-2.1")),
    ]
    got = {r.doc_id: r for r in license_texts.scan_license_texts(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert {i: (r.n_matches, r.licenses) for i, r in got.items()} == {i: want for i, _, want in rows}
    assert got[1].best == got[7].best == 1.0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert {r[0]: r[1:] for r in con.sql(license_texts.sql()).fetchall()} == {i: tuple(r)[1:] for i, r in got.items()}
    assert license_texts.scan_license_texts(odd).where("n_matches > 0").count() == 0
    assert license_texts.scan_license_texts(odd).count() == odd.count()
    assert license_texts.scan_license_texts(nothing).count() == 0


def test_license_runs_against_brute_force(spark):
    r = random.Random(4)
    draw = lambda letters, n: "\n".join(" ".join(r.choices(letters, k=r.randint(1, 5))) for _ in range(n))
    known = [("one", draw("abcde", 8)), ("two", draw("abcdef", 5)), ("word", "a")]
    texts = [draw("abcdefg", r.randint(0, 14)) for _ in range(60)] + [f"{draw('xy', 2)}\n{known[0][1]}\n{draw('xyab', 3)}\n{known[1][1]}. Z", known[1][1] + "\n" + known[1][1]]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[-1], None])), "doc_id long, text string")
    got = {x.doc_id: (x.n_matches, x.licenses, x.best) for x in license_texts.scan_license_texts(docs, known, 0.5).collect()}
    for i, text in enumerate([*texts, texts[-1], ""]):
        units = [w for u in re.split(licenses.UNIT_END, text.lower()) if (w := licenses.normal_words(u))]
        found = []
        for k, (_, t) in enumerate(known[:2]):
            w = licenses.normal_words(t)
            own, runs = set(zip(w, w[1:])), []
            for a in range(len(units)):
                for b in range(a + 1, len(units) + 1):
                    run, at = sum(units[a:b], []), sum(map(len, units[:a]))
                    s = set(zip(run, run[1:]))
                    begun = own & set(zip(run[: len(units[a])], run[1:]))
                    if begun and len(run) <= license_texts.longest(len(w), 0.5) and s:
                        runs.append((-2.0 * len(s & own) / (len(s) + len(own)), k, at, at + len(run)))
            found += [x for x in sorted(runs)[:1] if x[0] <= -0.5]
        took = []
        for f in sorted(found):
            if all(f[3] <= o[2] or o[3] <= f[2] for o in took):
                took.append(f)
        assert got[i] == (len(took), ",".join(sorted({known[f[1]][0] for f in took})), max((-f[0] for f in took), default=0.0)), text
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert {r[0]: r[1:] for r in con.sql(license_texts.sql(known, 0.5)).fetchall()} == got


def test_secret_spans(odd, nothing, spark):
    base = secrets.base_spans('token = "abc" API_KEY: 12345678 then deadbeef' + "0" * 24 + " AKIAAKIA12345678 AKIA1234")
    assert base == [("assign", 14, 31), ("hex", 37, 69), ("access", 70, 86)]
    model = secrets.train(documents(spark))
    r = random.Random(5)
    drawn = ["".join(r.choices(secrets.LETTERS[:62], k=32)) for _ in range(200)]
    plain = secrets.identifiers("value index reader window token_count total_size handler factory message service property".split(), 1300, seed=3)
    assert sum(bool(model.found(x, [])) for x in drawn) > 190
    assert sum(bool(model.found(x, [])) for x in plain) < 0.05 * len(plain)
    clean = ["-" * 40, "=-" * 20, "_" * 30, "+-+-" * 9, "usr/local/lib/python/site-packages", "20240101-120000", "4111111111111111", "getElementsByClassName", "org/example/app/MainActivity"]
    assert not any(model.found(x, []) for x in clean)
    assert model.spans(f"see {drawn[0]} and token = abcdefgh1 or {'-' * 30}")[0] == ("random", 4, 36)
    got = {x.doc_id: x for x in secrets.scan_documents(odd, model).collect()}
    assert (got[None].n_assign, got[9].n_access, got[4].spans) == (1, 3, "")
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan_documents(nothing).count() == 0


def test_secret_models_find_hidden_values_of_held_out_rows(spark):
    """With the patterns hidden, the models alone find the values of rows they never learnt from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = secrets.train(docs)
    values = hits = flagged = plain = 0
    for i, x in docs.where("text IS NOT NULL").toPandas().itertuples(index=False):
        base = secrets.base_spans(x)
        taken = secrets.apart(base)
        plain += sum(1 for _ in secrets.candidates(x, taken))
        flagged += len(model.found(x, taken))
        if base and zlib.crc32(str(i).encode()) % 10 == 0:
            alone = model.found(x, [])
            at = [secrets.ASSIGN.fullmatch(x, a, e).span(2) if k == "assign" else (a, e) for k, a, e in base]
            values += len(at)
            hits += sum(any(b < e and a < c for _, b, c in alone) for a, e in at)
    assert values > 20 and hits >= 0.9 * values
    assert flagged <= 0.001 * plain


def test_stretches_apart_and_candidates_equal_the_pairwise_rule():
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choices("abcdefghijkl -=", weights=[6] * 12 + [1, 1, 1], k=400))
        spans = sorted([("hex", a, a + r.randint(1, 40)) for a in r.sample(range(360), 5)], key=lambda s: s[1])
        want = [m.span() for m in secrets.CANDIDATE.finditer(text) if len({c for c in m.group() if c.isalnum()}) >= secrets.LEAST_DIFFERENT]
        assert list(secrets.candidates(text, secrets.apart(spans))) == [(a, e) for a, e in want if all(e <= b or a >= c for _, b, c in spans)]


def test_toxicity_held_out(spark, odd, labels, nothing):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.toxicity_scores(d, lab).join(lab, "doc_id").where("held_out").collect()
    right = [r.predicted == r.toxic for r in rows]
    assert sum(right) / len(right) > 0.9  # some 250 rows to learn from
    assert sum(r.predicted for r in rows if not r.toxic) <= 2
    got = toxicity.toxicity_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_scores(nothing, labels).count() == 0
    assert toxicity.toxicity_scores(odd, labels.limit(0)).agg(F.max("score")).first()[0] < 0.01


def test_identity_terms_carry_no_weight(spark):
    insult, plain = ["idiot fool", "moron scum"], ["nice day", "good food", "long walk"]
    rows = [(f"the women are {x}", 1) for x in insult * 20] + [(f"the men are {x}", 0) for x in plain * 20] + [(f"they are {x}", 0) for x in plain * 20]
    gaps = []
    for fairness in (0.0, 20.0):
        s = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"), fairness=fairness).scorer()
        gaps.append(s("the women met") - s("the men met"))
    assert gaps[0] > 0.1 and abs(gaps[1]) < gaps[0] / 3


def test_mixing_meets_its_targets(spark, odd, nothing):
    d = documents(spark)
    rows = mixing.mix_sources(d).collect()
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(mixing.mix_sources(d.repartition(7)).collect())]
    total = sum(r.size for r in rows)
    per = {r.target: r for r in rows}
    goal = sum({(r.source_size, r.target): r.target for r in rows}.values())
    assert abs(goal - 1.5 * total) < 1e-6 * total and per
    taken, target, largest = Counter(), {}, Counter()
    for r, s in zip(sorted(rows, key=lambda r: r.doc_id), sorted(d.collect(), key=lambda r: r.doc_id)):
        taken[s.source] += r.taken
        target[s.source] = r.target
        largest[s.source] = max(largest[s.source], r.size)
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert mixing.mix_sources(odd).count() == odd.count()
    assert mixing.mixture(odd).columns == odd.columns
    assert mixing.mix_sources(nothing).count() == 0


def test_pages_labelled_by_layout(spark, nothing):
    model = html_text.default_model()
    right = wrong = missed = 0
    for page, content in html_text.labelled_pages(120, seed=77):
        got, want = Counter(model.text(page).split("\n")), Counter(content)
        right += sum((got & want).values())
        wrong += sum((got - want).values())
        missed += sum((want - got).values())
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.95
    page = "<body><nav><a href=x>Menu</a></nav><article><h1>A &amp; b&copy</h1><p>One  <b>two</b>\n three.<p>Four<br>five.</article><script>var x='<p>no</p>'</script><footer>&copy; me</footer>"
    assert model.text(page) == "A & b©\nOne two three.\nFour five."
    d = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "y"), (3, "u", "", "z"), (1, "u", page, "x"), (4, "u", "<div>" * 5000 + "deep", "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(d).collect()
    assert len(got) == 5 and {r.page_id: r.n_chars for r in got}[2] == 0
    assert html_text.extract_pages(d.limit(0)).count() == 0


def test_silent_elements_end_with_their_block():
    said = lambda h: [n.text[0] for n in html_text.parse(h) if n.tag == "#text"]
    for tag in ("<svg class=x/>", "<math/>", "<svg><path d='z'/><g><title>t</title></g></svg>", "<video><p>old</p></video>", "<select><option>one</select>"):
        assert said(f"<div><p>a</p>{tag}<p>b</p></div><p>c</p>") == ["a", "b", "c"]
    for tag in ("<video>", "<object>", "<select>", "<svg>", "<video><div>old</div>"):
        assert said(f"<div><p>a</p>{tag}old</div><p>c</p>") == ["a", "c"]
    assert said("<div>a<template>b</div></template>c</div>d") == ["ac", "d"]
    assert said("<div>a<video><div/>b</div>c</video>d</div>") == ["ad"]
    assert said("<p>a</p></video></svg><p>b</p>") == ["a", "b"]
