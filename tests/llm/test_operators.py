"""The operators on odd and empty tables, against brute force written another way."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chronolake.llm import catalogue, common, decontaminate, docstats, htmltext, maxent, mixing, neardup, quality, rules, tokenfile, toxicity, urlfilter, wordscan

from .conftest import BENCH, DOCS, TURNS

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


QUERIES = catalogue.queries() | {"pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_odd_tables_keep_every_row(spark, odd, name):
    rows = catalogue.queries()[name](spark, odd).collect()
    if name.startswith(("op1_", "op6_", "op11_")):
        assert len(rows) == (len({t[0] for t in TURNS}) if name.startswith("op11_") else 6)
    elif not name.startswith("op12_"):
        assert len(rows) == len(DOCS)


def test_clashing_columns_change_nothing(spark, odd, clashing):
    """Results on documents with further columns of the results' names equal those without them."""
    key = lambda df: sorted(map(str, df.collect()))
    plain, labels = common.table(spark, odd, "documents"), common.table(spark, odd, "labels")
    learned = rules.fitted(plain, labels)
    columns = ["doc_id", "n_words", "kept"]
    assert key(rules.judged(clashing, learned).select(*columns)) == key(rules.judged(plain, learned).select(*columns))
    held = docstats.held_out(7, 2)
    ends = lambda df: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in df.collect())
    assert ends(maxent.scored(clashing, held)) == ends(maxent.scored(plain, held))
    digest = lambda df: key(tokenfile.digests(spark, tokenfile.token_file(df, VOCABULARY)))
    assert digest(clashing) == digest(plain)
    model = quality.fitted(plain, labels, ~docstats.held_out(5, 0))
    assert quality.accepted(clashing, model, 0.0).columns == clashing.columns
    tox = toxicity.located(clashing, toxicity.fitted(plain, labels, ~docstats.held_out(4, 2)))
    assert tox.columns[:-2] == [c for c in clashing.columns if c not in ("score", "offending")] and tox.count() == len(DOCS)
    pages = common.table(spark, odd, "pages").withColumn("text", F.lit("own")).withColumn("score", F.lit(1))
    assert key(htmltext.extracted(pages, htmltext.trained()).select("page_id", "text")) == key(htmltext.op6_html_text(spark, odd).select("page_id", "text"))


def test_pipeline(spark, odd):
    docs = common.table(spark, odd, "documents").withColumn("score", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
    assert [r["start"] for r in corpus_pipeline.run(spark, odd).orderBy("start").collect()][:1] == [0]


def test_pipeline_against_brute_force(spark, tmp_path):
    """All rows of run(): the stages in plain Python, given the fitted quality model's scores."""
    docs = common.table(spark, SMALL, "documents")
    model = quality.fitted(docs, common.table(spark, SMALL, "labels"), ~docstats.held_out(5, 0))
    rows = {r["doc_id"]: r for r in quality.scored(docs, model, name="_q").collect()}
    texts = {i: r["text"] for i, r in rows.items() if r["_q"] >= corpus_pipeline.KEEP}
    parent, _ = components_by_force(list(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if parent[i] == i}
    tests = set()
    for r in common.table(spark, SMALL, "benchmark").collect():
        w = alnum(r["text"])
        tests |= {tuple(w[k : k + min(10, len(w))]) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(t) for t in tests}
    clean = lambda w: not any(tuple(w[k : k + n]) in tests for n in sizes for k in range(len(w) - n + 1))
    texts = {i: t for i, t in texts.items() if clean(alnum(t))}
    count = {i: len(split(t)) for i, t in texts.items()}
    per = Counter()
    for i, n in count.items():
        per[rows[i]["source"]] += n
    target = mixed_by_force(per)
    number = {i: int(hashlib.md5(f"7|{i}".encode()).hexdigest()[:13], 16) for i in texts}
    bits, times = 1 << 52, {}
    for s in per:
        ids, rate = [i for i in texts if rows[i]["source"] == s], target[s] / per[s] if per[s] else 0.0
        taken = lambda i, k, rate=rate: math.floor(rate) + (number[i] * (64 * k + 1) % bits / bits < rate - math.floor(rate))
        best = min(range(32), key=lambda k: (abs(sum(count[i] * taken(i, k) for i in ids) - target[s]), k))
        times |= {i: taken(i, best) for i in ids}
    tok, start, want = Tokenizer.from_file(VOCABULARY), 0, []
    for i in sorted(texts):
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        for _ in range(times[i]):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert [tuple(r) for r in corpus_pipeline.run(spark, SMALL).orderBy("start").collect()] == want
    assert 50 < len(want) and len(texts) < len(rows)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def mixed_by_force(sizes):
    """Targets: 150 % shared by weight, the excess over twice a source's size shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        level = left / max(sum(weight[s] for s in sizes if s not in full), 1e-9)
        more = {s for s in sizes if s not in full and weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: float(2 * sizes[s]) if s in full else weight[s] * level for s in sizes}
        full |= more


def test_op1_rules(spark, odd):
    got = {r["page_id"]: r for r in urlfilter.op1_url_filter(spark, odd).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2]["host"], got[2]["path"], got[2]["rule"]) == ("", "", None)
    assert (got[3]["host"], got[4]["rule"], got[5]["path"], got[6]["rule"]) == ("", "com/fr/", "", "com/de/")


def test_op1_against_brute_force(spark, clashing):
    """Every row of a table: the longest fitting rule, else the score against the threshold."""
    pages = common.table(spark, SMALL, "pages")
    model = urlfilter.fitted(pages)
    out = urlfilter.judged(pages.withColumn("score", F.lit("own")).withColumn("h", F.lit(1)), model)
    assert out.columns == ["page_id", "url", "html", "h", "path", "host", "rule", "verdict", "score"]
    decided = 0
    for r in out.collect():
        rest = (r["url"] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(act, rule) for act, rule in urlfilter.RULES if (low(host) == rule.partition("/")[0] or low(host).endswith("." + rule.partition("/")[0])) and path.startswith("/" + rule.partition("/")[2])]
        act, rule = max(fits, key=lambda x: len(x[1]), default=(None, None))
        score = None if act else model.score(r["url"])
        decided += act is not None
        assert (r["host"], r["path"], r["rule"]) == (low(host), path, rule)
        assert r["score"] == (None if score is None else pytest.approx(score)) and r["verdict"] == (act or ("allow" if score >= model.threshold else "block"))
    assert 0 < decided < pages.count() and max(model.errors) < 0.5


def test_op1_model_tells_kinds_apart():
    good, bad = [f"http://good.net/{k}/story" for k in range(200)], [f"http://casino{k}.biz/win-win" for k in range(200)]
    model = urlfilter.Ratio(good, bad)
    assert model.errors == (0.0, 0.0) and model.score("http://good.net/999/story") > model.threshold > model.score("http://casino999.biz/win")
    assert sum(model.good.chance("\x02" * 5, c) for c in map(chr, range(128))) < 1.01


def test_op2_finds_the_sentence(spark):
    rng = np.random.default_rng(1)
    clean = ["alpha", "beta", "gamma", "delta", "table", "chair", "window"]

    def text(bad):
        lines = [" ".join(rng.choice(clean, 6)) for _ in range(5)]
        if bad:
            lines[2] += " idiot"
        return ". ".join(lines)

    rows = [(k, text(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("offending", F.lit("own"))
    model = toxicity.fitted(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), ~docstats.held_out(4, 2))
    for r in toxicity.located(docs, model).collect():
        assert (r["score"] >= 0.3) == bool(r["toxic"])
        assert ["idiot" in r["text"][x["first"] : x["stop"]] for x in r["offending"]] == [True] * r["toxic"]


def test_op3_statistics(spark, odd):
    got = {(r["doc_id"], r["n_words"]): r for r in rules.op3_quality_rules(spark, odd).collect()}
    for doc_id, text, *_ in DOCS:
        w, seen, dup = split(text), set(), 0
        for line in (text or "").split("\n"):
            if split(line):
                dup += line in seen
                seen.add(line)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        often = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
        r = got[doc_id, len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["kept"] and r["base_failed"])


def statistics_by_force(text):
    """All statistics of a text, counted character by character and word by word."""
    text = text or ""
    w, raw = split(text), text.encode()
    lines, seen, dup = [x for x in text.split("\n") if split(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    often = Counter(grams)
    covered = len({k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)})
    chars, n = sum(map(len, w)), len(w)
    count = lambda marks: sum(c in marks for c in text)
    letters = sum(b in range(65, 91) or b in range(97, 123) or b >= 0xC3 for b in raw)
    share = lambda x, y: x / max(y, 1)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": count("#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": covered,
        "mean_word": share(chars, n), "symbol_share": share(count("#*$%&|<>"), chars), "upper_share": share(sum("A" <= c <= "Z" for c in text), letters),
        "shout_share": share(count("!"), n), "bar_share": share(count("|"), n), "repeat_share": share(covered, n), "dup_line_share": share(dup, len(lines)),
        "same_share": share(sum(x == y for x, y in zip(w, w[1:], strict=False)), n), "distinct_share": share(len(set(w)), n),
        "digit_share": share(count("0123456789"), chars), "stop_share": share(count(".,;:?"), n), "line_share": share(len(lines), n),
    }


def test_op3_verdicts_against_brute_force(spark):
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    learned = rules.fitted(docs, common.table(spark, SMALL, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = rules.op3_quality_rules(spark, SMALL).collect()
    assert len(got) == len(texts) and learned
    for r in got:
        s = statistics_by_force(texts[r["doc_id"]])
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        hit = any(all(s[name] > cut if sign == ">" else s[name] <= cut for name, sign, cut in rule) for rule in learned)
        assert [r[c] for c in docstats.COUNTS] == [s[c] for c in docstats.COUNTS]
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not hit)


def test_op7_rows_against_brute_force(spark):
    """Scores from the densities of the fitted classes, over statistics counted another way."""
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    model = quality.fitted(docs, common.table(spark, SMALL, "labels"), ~docstats.held_out(5, 0))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in quality.op7_quality(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        s = statistics_by_force(text)
        x = np.array([math.log1p(s["n_words"]), math.log(s["mean_word"] + 1), *(math.sqrt(s[c]) for c in docstats.SHARES if c != "mean_word")])
        z, logs = (x - model.center) / model.scale, []
        for mean, inverse, _ in model.classes:
            covariance = np.linalg.inv(inverse.T @ inverse)
            logs.append(-0.5 * (z - mean) @ np.linalg.solve(covariance, z - mean) - 0.5 * np.linalg.slogdet(covariance)[1])
        margin = min(max(logs[1] - logs[0], -quality.LIMIT), quality.LIMIT)
        score = 1 / (1 + math.exp(-min(max(model.slope * margin + model.shift, -30), 30)))
        assert got[i]["score"] == pytest.approx(score, abs=1e-6) and got[i]["predicted"] == (got[i]["score"] >= 0.3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op2_rows_against_brute_force(spark):
    """Scores sentence by sentence from the fitted weights."""
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, common.table(spark, SMALL, "labels"), ~docstats.held_out(4, 2))
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    assert weight
    hash_of = lambda b: int(wordscan.Hashed(np.frombuffer(b, np.uint8)).ranges(np.array([0]), np.array([len(b)]))[0])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", low(text)):
            words = [x.encode() for x in alnum(sentence)]
            if words:
                features = {hash_of(b) for b in words} | {(hash_of(b[:n]) + n) % 2**64 for b in words for n in toxicity.BEGINNINGS if len(b) > n}
                clean *= 1 - 1 / (1 + math.exp(-model.bias - sum(weight.get(f, 0.0) for f in features)))
        assert got[i]["score"] == pytest.approx(1 - clean, abs=1e-9)
        assert (got[i]["held_out"], got[i]["predicted"]) == (zlib.crc32(str(i).encode()) % 4 == 2, got[i]["score"] >= 0.3)


def test_op3_learns_thresholds():
    rng = np.random.default_rng(0)
    x = {c: rng.random(900) for c in rules.INPUTS}
    bad = (x["symbol_share"] > 0.7) | ((x["bar_share"] > 0.5) & (x["line_share"] <= 0.3))
    learned = rules.learned(x, bad)
    covered = np.any([rules.covers(r, x) for r in learned], 0)
    assert (covered == bad).mean() > 0.95


@pytest.mark.parametrize("least", [(2,), (16, 4, 2), (8,)])
def test_op4_round_trip(least):
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 400, 50)
    ids = np.concatenate([np.tile(rng.integers(0, 60000, 7), 60)[:n] if k % 2 else rng.integers(0, 9, n) for k, n in enumerate(counts)]).astype(np.uint32)
    row = tokenfile.compress(ids, counts, least)
    shard = tokenfile.Shard(row)
    assert np.array_equal(shard.expand(shard.symbols), ids) and len(shard.symbols) < len(ids)
    for first, stop in ((0, 1), (5, 5), (17, 400), (len(ids) - 3, len(ids))):
        assert np.array_equal(shard.tokens(first, stop), ids[first:stop])


def test_op4_ids_and_starts(spark, odd):
    tok, start, want = Tokenizer.from_file(VOCABULARY), 0, []
    got = tokenfile.op4_token_file(spark, odd).orderBy("start").collect()
    texts = {}
    for i, t, *_ in DOCS:
        texts.setdefault(i, []).append(t or "")
    for i in sorted(texts, key=lambda k: (k is not None, k)):
        for t in texts[i]:
            ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert [tuple(r) for r in got] == want


ODD_PARTS = [*"abzAZIMLSDTVRE'.,!?09<|>-_ \n\t\x85\x1c\u00a0\u2009", "\u00e9", "\u00c9", "\u00df", "\u00c7", "\u00d7", "\u00f7", "\u00aa", "\u00b5", "\u0301", "\u0130", "\u4e2d", "\U0001f642", "\u2026", "\u2019", "\u03a3", "\ufb01", "\u212a", "\u0661", "\u1100\u1161", "'S", "'LL", "'m", "<|endoftext|>", "<|ENDOFTEXT|>", " the ", " it's "]


def encoded(enc, texts):
    raw = [t.encode() for t in texts]
    ids, counts = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    return [v.tolist() for v in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize(("known", "span", "n"), [(1 << 19, 1 << 19, 50000), (20, 64, 3000)])
def test_op4_ids_of_random_texts(monkeypatch, known, span, n):
    """Capitals and apostrophes beside emoji, Chinese characters, marks and special tokens, whatever the cache and the span."""
    monkeypatch.setattr(tokenfile, "SPAN", span)
    rng = np.random.default_rng(n)
    texts = ["".join(ODD_PARTS[k] for k in rng.integers(0, len(ODD_PARTS), rng.integers(0, 25))) for _ in range(n)]
    texts += ["I'M here \U0001f642", "\u4e2d IT'S", "WE'LL go \u2026 now", "x" * 500 + " " + "y\u00e9" * 300, ""]
    enc, tok = tokenfile.Encoder(VOCABULARY, known), Tokenizer.from_file(VOCABULARY)
    assert enc.fits and encoded(enc, texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_op4_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = tokenfile.Encoder(path), Tokenizer.from_file(path)
    texts = [d[1] or "" for d in DOCS if len(d[1] or "") < 500]
    assert not enc.fits and encoded(enc, texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_op4_no_pair_is_left():
    ids = np.random.default_rng(7).integers(0, 12, 4000).astype(np.uint32)
    row = tokenfile.compress(ids, np.array([1500, 2500]))
    symbols = np.frombuffer(row["symbols"], f"<u{row['width']}").tolist()
    cut = int(row["doc_symbols"][1])
    often = Counter(p for part in (symbols[:cut], symbols[cut:]) for p in zip(part, part[1:], strict=False) if p[0] != p[1])
    assert max(often.values()) < 2


def test_op5_against_all_windows(spark, odd, clashing):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    tests = []
    for item, t in BENCH:
        w = words(t)
        tests += [(item, w[k : k + min(10, len(w))]) for k in range(max(1, len(w) - 9)) if w]
    want = []
    for doc_id, text, *_ in DOCS:
        w, hit, items = words(text), set(), set()
        for item, test in tests:
            for k in range(len(w) - len(test) + 1):
                if w[k : k + len(test)] == test:
                    hit |= set(range(k, k + len(test)))
                    items.add(item)
        want.append((doc_id if doc_id is not None else -1, len(w), len(hit), len(items), bool(hit)))
    got = decontaminate.op5_decontaminate(spark, odd).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == sorted(want)
    clean = decontaminate.clean_rows(clashing, common.table(spark, odd, "benchmark"))
    assert clean.columns == clashing.columns and clean.count() == sum(not w[-1] for w in want)


def test_op5_blocks(spark, odd, monkeypatch):
    docs, bench = common.table(spark, odd, "documents"), common.table(spark, odd, "benchmark")
    key = lambda df: sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["spans"]], r["items"]) for r in df.collect())
    once = key(decontaminate.marked(docs, bench))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)
    for blocks in (1, 3):
        monkeypatch.setattr(decontaminate, "BLOCKS", blocks)
        assert key(decontaminate.marked(docs, bench)) == once


def test_op5_strings_that_many_items_share(spark):
    shared = " ".join(f"s{k}" for k in range(12))
    bench = spark.createDataFrame([(k, shared + f" own{k}") for k in range(300)] + [(None, "never counted"), (7, "x1 x2")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{shared} {shared} own5 never counted"), (2, "never counted"), (3, "x1 x2")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.marked(docs, bench).collect()}
    assert got[1]["items"] == list(range(300)) and [tuple(x) for x in got[1]["spans"]] == [(0, 25)]
    assert got[2]["items"] == [] and got[3]["items"] == [7]


def test_op6_pages(spark, odd):
    got = {r["page_id"]: r for r in htmltext.op6_html_text(spark, odd).collect()}
    assert got[1]["text"] == "Title of it\n\nFirst & second paragraph here.\n\nMore text follows in this one."
    assert got[2]["text"] == got[3]["text"] == "" and got[6]["n_chars"] == 20000 * 16 - 1


def test_op6_deep_and_long_pages_take_linear_time():
    import time

    model = htmltext.trained()
    for source in ("<div>x " * 100_000, "<b><i>" * 60_000 + "x" + "</b></u>" * 60_000, "<p>a</section>" * 50_000, "<a <a " * 60_000, "<div class='x y'><svg>z" * 30_000):
        began = time.process_time()
        assert len(htmltext.main_texts(model, [source])) == 1
        assert time.process_time() - began < 40


def test_op6_unclosed_elements_lose_no_text():
    model = htmltext.trained()
    for tag in ("svg", "object", "noscript", "select", "iframe", "template"):
        page = f"<html><body><nav><a href=/>menu here</a></nav><article><h1>Title of it</h1><p>First paragraph here, of some length.<{tag} class=x><p>More text follows in this one.<p>And a third paragraph.</article></body></html>"
        assert htmltext.main_texts(model, [page])[0].endswith("More text follows in this one.\n\nAnd a third paragraph."), tag
    closed = "<article><p>First paragraph here.</p><script>a='<!--'; b=\"<p>no</p></script><p>Second paragraph here.</p></article>"
    assert htmltext.main_texts(model, [closed])[0] == "First paragraph here.\n\nSecond paragraph here."


def test_op6_on_held_out_pages():
    """Against the marks of 200 pages that no tree was fitted to: shares of right words, and of words found."""
    rng, model = np.random.default_rng(99), htmltext.trained()
    right = got = want = 0
    for _ in range(200):
        source = htmltext.training_page(rng)
        marked = Counter(w.strip(htmltext.MAIN) for _, t, _ in htmltext.Page(source).texts for w in t.split() if w.startswith(htmltext.MAIN))
        found = Counter(htmltext.main_texts(model, [source.replace(htmltext.MAIN, "")])[0].split())
        right, got, want = right + (marked & found).total(), got + found.total(), want + marked.total()
    print("precision", right / got, "recall", right / want)
    assert right / got > 0.97 and right / want > 0.97


def test_op6_decoding_is_consistent():
    page = htmltext.Page("<div><div><p>a b</p></div><p>c d</p></div>")
    for chance in np.random.default_rng(0).random((50, len(page.tag))):
        state = page.states(chance)
        for k, p in enumerate(page.parent):
            assert p < 0 or not (state[p] == 1 and state[k] != 1) and not (state[p] == 2 and state[k] == 0)


def test_op7_tells_classes_apart():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 5)), rng.normal(0, 3, (100, 5))])
    y = np.repeat([1.0, 0.0], [300, 100])
    model = quality.Discriminant(x, y)
    score = model.score(x)
    assert ((score >= 0.5) == (y == 1)).mean() > 0.9 and score.min() >= 0 and score.max() <= 1
    assert quality.Discriminant(x[:5], np.ones(5)).score(x[:2]).tolist() == [1.0, 1.0]


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1}, {"a": 5}, {"x": 0, "y": 0}, {"a": 7, None: 9, "b": 1000, "c": 3, "d": 40}])
def test_op8_targets(spark, sizes):
    """The level equals sharing the excess again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        share, full = left / sum(weight[s] for s in open_), set()
        for s in open_:
            target[s] = min(2.0 * sizes[s], target[s] + weight[s] * share)
        full = {s for s in open_ if target[s] >= 2 * sizes[s] - 1e-9}
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        open_ -= full
        if not full:
            break
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(target)


def test_op8_copies(spark, odd, clashing):
    counts = mixing.mixed_counts(common.table(spark, odd, "documents")).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in counts)
    mix = mixing.mixed(clashing)
    assert mix.columns == clashing.columns and mix.count() == sum(r["n_copies"] for r in counts)


def test_op8_many_sources_are_ordered_in_ranges(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 40 > 0, F.concat(F.lit("s"), F.col("id") % 40)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"))
    once = sorted(tuple(r) for r in mixing.mixed_counts(rows).select("doc_id", "target", "taken").collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    assert sorted(tuple(r) for r in mixing.mixed_counts(rows).select("doc_id", "target", "taken").collect()) == once


def test_op8_small_sources_come_near_their_targets(spark):
    rows = mixing.op8_mix_sources(spark, SMALL).join(common.table(spark, SMALL, "documents").select("doc_id", "source"), "doc_id")
    per = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.any_value("target").alias("target"), F.max("size").alias("most")).collect()
    assert len(per) > 3 and all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] + r["most"] / 2 for r in per)
    plan = mixing.mixed(common.table(spark, SMALL, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_op9_base_and_model(spark, odd):
    got = maxent.op9_lm_score(spark, odd).collect()
    lists = [(i, [*split(low(t)), None]) for i, t, *_ in DOCS]
    count = Counter(w for i, ws in lists if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for w in ws)
    total, kinds = sum(count.values()), len(count)
    want = sorted((str(i), len(ws), sum(w in count for w in ws), round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws), 6)) for i, ws in lists)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == total and r["score"] <= 0 for r in got)


def _back(vocabulary, ids, first):
    """What the model sees of tokens that are given by id; id n is some rare token."""
    return maxent.Seen(vocabulary, np.append(vocabulary.sorted[np.argsort(vocabulary.order)], np.uint64(77))[ids], np.array(first))


def test_op9_chances_sum_to_one():
    rng = np.random.default_rng(4)
    vocabulary = maxent.Words(rng.integers(1, 2**62, 200).astype(np.uint64), np.sort(rng.integers(1, 500, 200))[::-1], 32)
    model = maxent.Model(vocabulary, 50, 20, int(vocabulary.counts.sum()) + 50, 1 << 10, 1 << 10)
    model.classes[:-1] = rng.normal(0, 1, model.classes[:-1].shape)
    model.inner[:] = rng.normal(0, 1, model.inner.shape)
    for history in ([3, 7, 200], [200, 0, 1]):
        texts = np.array([[*history, k] for k in range(201)])
        logs = model.log_chances(_back(vocabulary, texts.ravel(), 4 * np.arange(202))).reshape(-1, 4)[:, 3]
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_op9_updates_lower_the_loss_and_draws_follow_the_model():
    rng = np.random.default_rng(5)
    ids = np.cumsum(rng.choice([1, 1, 1, 5], 20000)) % 40
    vocabulary = maxent.Words(np.arange(1, 41, dtype=np.uint64) * np.uint64(977), np.full(40, 500), 32)
    model = maxent.Model(vocabulary, 0, 0, 20000, 1 << 12, 1 << 12)
    seen = _back(vocabulary, ids, np.arange(0, 20001, 50))
    tables = model.classes.size, model.inner.size
    losses = [model.log_chances(seen).mean()]
    observed = [np.zeros(n, np.int32) for n in tables]
    model.observed(seen, *observed)

    def change(step, *kinds):
        widths = model.classes.shape[1], model.inner.shape[1]
        model.changed([(k, step(k, np.concatenate([v[t][a * widths[t] : b * widths[t]] for v in kinds])).tobytes()) for k, (t, a, b) in enumerate(model.blocks())])
        losses.append(model.log_chances(seen).mean())

    change(model.steps().first, observed)
    expected = [np.zeros(n, np.int32) for n in tables]
    model.expected(seen, *expected)
    assert expected[0].sum() == observed[0].sum() == 4 * len(ids) and expected[1].sum() == observed[1].sum()
    mean = np.zeros(maxent.CLASSES + 1)
    for _, _, _, weight, *_ in model.chunks(seen):
        mean += (weight / weight.sum(1, keepdims=True)).sum(0)
    drawn = expected[0].reshape(-1, maxent.CLASSES + 1).sum(0) / 4
    assert np.abs(drawn - mean).max() < 5 * np.sqrt(len(ids)) / 2
    change(model.steps().further, observed, expected)
    assert losses[0] + 0.5 < losses[1] < losses[2]


def test_op9_work_on_words_is_done_once_a_model(monkeypatch):
    """Weights of words are not gathered for each token, and neither sums nor draws depend on how tokens are cut into chunks."""
    rng = np.random.default_rng(6)
    vocabulary = maxent.Words(rng.integers(1, 2**62, 4000).astype(np.uint64), np.sort(rng.integers(1, 500, 4000))[::-1], 64)
    model = maxent.Model(vocabulary, 50, 20, int(vocabulary.counts.sum()) + 50, 1 << 10, 1 << 10)
    model.classes[:-1] = rng.normal(0, 1, model.classes[:-1].shape)
    model.inner[:] = rng.normal(0, 1, model.inner.shape)
    ids = rng.integers(0, 4001, 30000)
    seen = _back(vocabulary, ids, np.arange(0, 30001, 50))
    assert np.array_equal(seen.ids, ids)
    logs, counts, gathered, take = [], [], [], np.take

    def counted(*args, **options):
        gathered.append(take(*args, **options))
        return gathered[-1]

    for size in (1 << 12, 1 << 12, 7):
        monkeypatch.setattr(maxent, "CHUNK", size)
        with monkeypatch.context() as m:
            m.setattr(np, "take", counted)
            logs.append(model.log_chances(seen))
            counts.append([np.zeros(t.size, np.int32) for t in (model.classes, model.inner)])
            model.expected(seen, *counts[-1])
        assert sum(g.size for g in gathered) <= 2 * 4 * (maxent.CLASSES + 1) * len(ids)
        gathered.clear()
    assert np.array_equal(logs[0], logs[2]) and all(np.array_equal(a, b) for a, b in zip(counts[0], counts[2], strict=True))
    # a token's chance in its class is that of its weight among those of the row
    own = np.flatnonzero(ids < 4000)
    at, spot = model.inner_rows(seen, own), vocabulary.spot[ids[own]]
    scores = (model.inner[at] + model.word_bias[vocabulary.group[ids[own]]]).astype(float)
    inside = scores[np.arange(len(own)), spot] - np.log(np.exp(scores).sum(1))
    for here, _, group, weight in model.chunks(seen):
        logs[0][here] -= np.log(weight[np.arange(len(group)), group] / weight.sum(1))
    assert logs[0][own] == pytest.approx(inside, abs=1e-4) and np.abs(np.delete(logs[0], own)).max() < 1e-6


def test_op9_words_are_found_whatever_places_their_hashes_share():
    rng = np.random.default_rng(7)
    top = rng.integers(0, 40, 600).astype(np.uint64) << np.uint64(46)
    hashes = np.unique(top + rng.integers(0, 2**46, 600).astype(np.uint64))
    rng.shuffle(hashes)
    for n in (0, 1, 300):
        some, every = maxent.Words(hashes[:n], np.ones(n, np.int64), 32), np.append(hashes, [np.uint64(0), ~np.uint64(0)])
        assert some.ids(every).tolist() == [*range(n), *[n] * (len(every) - n)]
    assert maxent.Words(every[[-1, -2, 0]], np.ones(3, np.int64), 32).ids(every[[0, 1, -2, -1]]).tolist() == [2, 3, 1, 0]


def test_op9_beats_the_base_on_held_out_rows(spark):
    """And two runs over other partitions agree."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 7 == 2
    runs = [{r["doc_id"]: r for r in maxent.scored(docs.repartition(n), held).collect()} for n in (2, 5)]
    assert {k: tuple(r)[:-1] for k, r in runs[0].items()} == {k: tuple(r)[:-1] for k, r in runs[1].items()}
    assert all(r["score"] == pytest.approx(runs[1][k]["score"], rel=1e-9) for k, r in runs[0].items())
    rows = [r for r in runs[0].values() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] - r["base_score"] for r in rows) / tokens > 0.01


def components_by_force(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = split(low(t))
        sets[i] = set(zip(*[w[k:] for k in range(size)], strict=False)) if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_op10_against_all_pairs(spark, size, percent):
    rng = np.random.default_rng(size)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = []
    for family in range(12):
        base = list(rng.choice(vocabulary, int(rng.choice([4, 12, 60, 200]))))
        for _ in range(14):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 25)))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "one"), (len(docs) + 3, "ONE"), (len(docs) + 4, docs[0][1])]
    want, sets = components_by_force(docs, size, percent)
    got = neardup.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), size, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op10_open_pairs_in_blocks(spark, monkeypatch):
    """Members that do not link to their hub but to each other are found, whatever the block size."""
    rng = np.random.default_rng(8)
    base = [f"v{k}" for k in range(100)]
    docs = [(0, " ".join(base))]
    for group in range(6):
        other = base[:20] + [f"g{group}_{k}" for k in range(4)] + base[24:96]
        for _ in range(6):
            copy = list(other)
            copy[int(rng.integers(30, 90))] = f"x{len(docs)}"
            docs.append((len(docs), " ".join(copy)))
    want, _ = components_by_force(docs, 3, 85)
    for block in (2, 128):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_op10_rows_without_an_id_and_repeated_ids(spark):
    base = [f"w{k}" for k in range(200)]
    step = lambda k: " ".join([f"x{j}" for j in range(5 * k)] + base[5 * k :])
    docs = [(7, step(0)), (None, step(1)), (None, step(2)), (30, step(3)), (40, "quite another text of its own"), (40, step(3) + " more"), (None, "alone without an id"), (None, "alone without an id"), (8, None)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()), key=str)
    want = [(7, 7, True), (None, 7, False), (None, 7, False), (30, 7, False), (40, 40, True), (40, 7, False), (None, None, True), (None, None, True), (8, 8, True)]
    assert got == sorted(want, key=str)
    kept = neardup.kept_rows(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("7", step(0)), ("40", docs[4][1]), ("None", docs[6][1]), ("8", None)], key=str)


def test_op10_one_template_with_many_fillings(spark, monkeypatch):
    """Pages of one template that share 70 % are no links; some pairs among them are, though not to the hub."""
    monkeypatch.setattr(neardup, "MEMBERS", 16)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    frame, docs = [f"t{k}" for k in range(140)], []
    for k in range(120):
        own = [f"f{k}_{j}" for j in range(60)]
        docs.append((len(docs), " ".join(frame + own)))
        if k % 10 == 3:
            own[5] = "other"
            docs.append((len(docs), " ".join(frame + own)))
    want, _ = components_by_force(docs, 3, 85)
    met, write = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: met.append(df.count()) or write(df, name) if name == "near-met" else write(df, name))
    got = neardup.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) == 120
    assert sum(met) <= 12 * 2 * 8  # the pairs, by the hubs they share; those without a partner drop out


def test_op10_rows_that_stay(spark, clashing):
    out = neardup.kept_rows(clashing)
    assert out.columns == clashing.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 5 not in ids and ids.count(10) == 1 and {0, 1, 2, 3, 4, 6} <= set(ids)


def test_words_of_texts():
    texts = ["Ab  cD\u00e9", "", "x", "\n y z\t"]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    low_bytes, a, b, h, first = wordscan.words(np.frombuffer(b"".join(raw), np.uint8), off, wordscan.NONSPACE)
    assert [low_bytes[s:e].tobytes().decode() for s, e in zip(a, b, strict=True)] == ["ab", "cd\u00e9", "x", "y", "z"]
    assert np.diff(first).tolist() == [2, 0, 1, 2] and len(set(h.tolist())) == 5


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    found = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = catalogue.queries()[name](spark, SMALL).select(*columns).collect()
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(got) == plain(found.fetchall())


def _two_kinds(spark):
    """3,000 good and 300 bad documents in which short texts are of either kind."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(3300):
        bad = k % 11 == 0
        n = int(rng.integers(60, 140)) if rng.random() < 0.5 else int(rng.integers(20, 60) if bad else rng.integers(140, 200))
        rows.append((k, " ".join(rng.choice(["tree", "river", "stone", "cloud", "vile"], n, p=[0.25, 0.25, 0.25, 0.25 - 0.002 * bad, 0.002 * bad])), int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_samples_keep_the_shares_of_classes(spark):
    """A capped sample has the shares of the whole table, so that scores do not depend on its size."""
    d = _two_kinds(spark).cache()
    docs, labels = d.select("doc_id", "text"), d.select("doc_id", "quality", "toxic")
    sums = docstats.labelled_sample(docs, labels, "quality", 400, F.lit(True)).groupBy("label").agg(F.count("*"), F.sum("weight")).collect()
    assert sorted(tuple(r) for r in sums) == [(0, 300, 300.0), (1, 400, 3000.0)]
    for limit in (400, 5000):
        model = quality.fitted(docs, labels, F.lit(True), limit)
        assert abs(quality.scored(docs, model).agg(F.avg("score")).first()[0] - 3000 / 3300) < 0.02
        tox = toxicity.fitted(docs, labels, F.lit(True), limit)
        assert abs(toxicity.located(docs, tox).agg(F.avg("score")).first()[0] - 300 / 3300) < 0.03


def test_op3_precision_counts_what_rows_stand_for():
    """A rule that is right in a capped sample but wrong in the whole table is not learned."""
    x = {c: np.zeros(1200) for c in rules.INPUTS}
    bad = np.arange(1200) % 2 == 0
    x["bar_share"] = (bad | (np.arange(1200) % 101 == 1)) * 0.5
    assert (rules.covers([("bar_share", ">", 0.0)], x) & ~bad).sum() in range(1, 10)
    assert rules.learned(x, bad)
    assert not rules.learned(x, bad, np.where(bad, 1.0, 20.0))


def test_op5_and_op3_with_text_ids(spark):
    """Ids of items and documents may be texts."""
    docs = spark.createDataFrame([("d1", "xx alpha beta yy gamma delta"), ("d2", "none of it")], "doc_id string, text string")
    bench = spark.createDataFrame([("q10", "alpha beta"), ("q9", "gamma delta"), ("q9", "alpha beta"), (None, "none")], "item_id string, text string")
    got = {r["doc_id"]: (r["items"], [tuple(s) for s in r["spans"]]) for r in decontaminate.marked(docs, bench).collect()}
    assert got == {"d1": (["q10", "q9"], [(1, 3), (4, 6)]), "d2": ([], [])}
    good, bad = "A sentence of plain words follows another one here. " * 12, "BUY!!! NOW!!! | | | WIN WIN WIN $$$ 999 000 | " * 20
    many = [(f"k{k}", f"{good if k % 2 else bad} {k}", int(k % 2)) for k in range(240)]
    rows = spark.createDataFrame([r[:2] for r in many], "doc_id string, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in many], "doc_id string, quality int, toxic int")
    learned = rules.fitted(rows, labels)
    assert learned and rules.judged(rows, learned).where("kept").count() <= 120


def test_rare_tokens_have_a_history_of_their_own(spark, monkeypatch):
    """Tokens outside the model's words are scored by exact counts after each last token, whatever their number."""
    rng, held = np.random.default_rng(11), F.col("doc_id") % 5 == 0
    names = [f"w{k}" for k in range(6000)]
    texts = {k: " ".join(names[i] for i in np.where(rng.random(400) < 0.5, rng.integers(0, 40, 400), rng.integers(0, 6000, 400))) + " w2990 w2991" for k in range(60)} | {60: None, 61: "never w2991", 65: "w2990 w2991 never again"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).localCheckpoint()
    monkeypatch.setattr(maxent, "PART", 500)
    monkeypatch.setattr(maxent, "PARTS", 3)

    def scores(prior):
        monkeypatch.setattr(maxent, "RARE_PRIOR", prior)
        return {r["doc_id"]: r["score"] for r in maxent.scored(docs, held).collect()}

    apart, prior = {}, 20.0
    got, flat = scores(prior), scores(1e13)  # the latter leaves the shares of rare tokens alone
    lines = {k: [*(t or "").split(), None] for k, t in texts.items()}  # None: the end
    hashes = {w: int(maxent.tokens(*common.text_buffers(pa.array([w or ""])))[0][0]) for line in lines.values() for w in line}
    counts = Counter(w for k, line in lines.items() if k % 5 for w in line)
    words = sorted(counts, key=lambda w: (-counts[w], int(np.uint64(hashes[w]).view(np.int64))))[: maxent.CLASSES * maxent.shape(sum(counts.values()))[0]]
    rare = {w for line in lines.values() for w in line} - set(words)
    whole = sum(counts[w] for w in rare) + sum(counts[w] > 0 for w in rare) + 1
    assert len(words) < len(counts)
    pairs, after = Counter(), Counter()
    for k, line in lines.items():
        for a, b in zip(["start", *line], line) if k % 5 else ():
            pairs[a, b] += b in rare
            after[a] += b in rare
    for k, line in lines.items():
        apart[k] = 0.0
        for a, b in zip(["start", *line], line):
            share = (counts[b] + 1) / whole
            apart[k] += math.log10((pairs[a, b] + prior * share) / (after[a] + prior) / share) if b in rare else 0
    assert {k: got[k] - flat[k] for k in got} == pytest.approx(apart, abs=1e-6)
    assert min(map(abs, (apart[k] for k in range(60)))) > 0.1


def test_pieces_that_come_again_stay_in_a_full_table():
    enc, tok = tokenfile.Encoder(VOCABULARY, 300), Tokenizer.from_file(VOCABULARY)
    asked, ask = [], enc._asked
    enc._asked = lambda plain, odd: asked.extend(plain) or ask(plain, odd)
    for k in range(12):
        text = " ".join([f"often{chr(97 + j)}" for j in range(20)] + [f"q{chr(97 + k)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(90)])
        ids, _ = enc.encode(*common.text_buffers(pa.array([text])))
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
    assert enc.n < 500 and max(Counter(asked).values()) == 1
