import math
import re
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD, prose
from pyspark.sql import functions as F

from georesolve.llm import chat, fingerprint, language, toxicity, url_filter
from georesolve.llm.common import drawn, word_hash


def test_language_of_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out(F.col("doc_id")))
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_backs_off_to_shorter_grams(spark):
    docs = spark.createDataFrame([(1, "abcde abcde abcde", "x"), (2, "vwxyz vwxyz vwxyz", "y")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    longest = model.of_words(["abcdx"])[0]
    assert longest[0] > longest[1]
    _, ends = model.logs(1, np.array([word_hash("^"), word_hash("$")], dtype=np.uint64))
    assert np.allclose(model.of_words(["日本"])[0], ends.mean(axis=0))
    other = model.of_words(["qqqq"])[0]
    assert other[0] == pytest.approx(other[1])


def plain_language(rows, texts):
    """The scorer by its definition, in plain Python: rows (lang, text) teach."""
    langs = sorted({lang for lang, _ in rows})
    counts = [{lang: Counter() for lang in langs} for _ in range(6)]
    for lang, text in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts[0][lang][w] += 1
            for k in range(1, 6):
                counts[k][lang].update(f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k))
    known = [set().union(*c.values()) for c in counts]

    def log(k, x):
        return np.array([math.log((c[x] + 0.5) / (sum(c.values()) + 0.5 * len(known[k]))) for c in counts[k].values()])

    def word(w):
        if w in known[0]:
            return log(0, w)
        for k in range(5, 0, -1):
            found = [log(k, g) for g in (f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)) if g in known[k]]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(langs))

    docs = Counter(lang for lang, _ in rows)
    prior = np.array([math.log((docs[lang] + 1) / (len(rows) + len(langs))) for lang in langs])
    for t in texts:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        logs = prior + sum((word(w) for w in words), np.zeros(len(langs)))
        p = np.exp(logs - logs.max())
        yield (langs[int(p.argmax())], p.max() / p.sum()) if any(c.isalpha() for c in "".join(words)) else ("und", 0.0)


def test_language_scores_are_those_of_a_plain_version(spark):
    rows = [("x", prose(i, 30)) for i in range(5)] + [("y", prose(i + 50, 30).replace("a", "o")) for i in range(4)] + [("z", "½ abc zzz")]
    texts = [prose(90, 20), "alpho zzq", "½ ²", None, "", "unmet ωω", "Beto gommos"]
    model = language.fit(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, (lang, score) in enumerate(plain_language(rows, texts)):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-5), texts[i]


def test_samples_of_huge_inputs_are_never_empty(spark):
    rows = spark.range(200_000).select("id", drawn(F.col("id"), 50_000_000_000, 20_000).alias("none"), drawn(F.col("id"), 2_000_000, 20_000).alias("some"), drawn(F.col("id"), 10, 20).alias("every"))
    none, some, every = rows.agg(*[F.sum(F.col(c).cast("int")) for c in ("none", "some", "every")]).first()
    assert none <= 2 and 1_700 < some < 2_300 and every == 200_000
    bound = -(1 << 63) + (20_000 << 64) // 50_000_000_000
    assert (bound + (1 << 63)) / 2**64 == pytest.approx(4e-7)


def test_language_of_odd_rows(odd, empty):
    model = language.fit(odd)
    rows = language.identify(odd, model).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.doc_id for r in rows if r.lang_pred == "und" and r.doc_id) == [3, 4, 8]
    assert {r.lang_pred for r in language.identify(odd, language.fit(empty)).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0
    kept = language.keep_identified(odd, model)
    assert kept.schema == odd.schema and kept.count() == len(ODD) - 3


@pytest.mark.parametrize("common", [0, 8, 64])
def test_nearest_examples_are_those_of_a_full_scan(common):
    rng = np.random.default_rng(4)
    made = [rng.choice(60, rng.integers(1, 12), replace=False, p=np.arange(60, 0, -1) / 1830) for _ in range(1200)]
    hashes = np.array([word_hash(f"t{t}") for d in made for t in d], dtype=np.uint64)
    counts = rng.integers(1, 4, len(hashes)).astype(np.float32)
    y = (rng.random(1200) < 0.2).astype(float)
    index = toxicity.Index(np.arange(1200), y, np.array([len(d) for d in made]), hashes, counts, common)
    number = {int(k): i for i, k in enumerate(index.keys.tolist())}
    terms, cut = np.array([number[int(h)] for h in hashes.tolist()]), np.cumsum([0, *[len(d) for d in made]])
    examples = [(terms[a:b], counts[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    dense = np.zeros((1200, len(index.keys)))
    for i, (t, c) in enumerate(examples):
        dense[index.place[i], t] = index.unit(t, c)
    queries = examples[:150] + [(t, np.ones(len(t), dtype=np.float32)) for t, _ in examples[150:200]] + [(terms[:0], counts[:0])]
    out = [index.place[i] for i in range(150)] + [-1] * 51
    for (t, c), skip, (at, cos) in zip(queries, out, index.nearest(queries, leave_out=out), strict=True):
        q = np.zeros(len(index.keys))
        if len(t):
            q[t] = index.unit(t, c)
        want = dense @ q
        want[skip if skip >= 0 else []] = 0
        best = np.sort(want[want > 1e-9])[::-1][: toxicity.NEIGHBOURS]
        assert len(at) == len(best) and np.allclose(cos, best, atol=1e-5) and np.allclose(want[at], cos, atol=1e-5)


def test_label_weights_and_curve():
    df, df1 = np.array([40, 400, 2, 1, 100]), np.array([40, 80, 2, 1, 5])
    g = toxicity.label_weights(df, df1, 1000, 200)
    assert g[0] == 1 and g[2] < 0.2 and np.allclose(g[[1, 3, 4]], toxicity.FLOOR)
    curve = toxicity.curve_of(np.array([0.0, 0.1, 0.2, 0.6, 0.7]), np.array([0, 1, 0, 1, 1]), 0.2)
    assert 0 <= curve(0) <= curve(0.15) <= curve(0.65) <= 1 and curve.x == sorted(curve.x)


def test_toxicity_of_planted_words(spark):
    rows = [(i, prose(i, 80) + (" vileword nastyword" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 300], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, index).collect()}
    assert all((got[i].score >= 0.3) == bool(y) for i, _, y in rows)
    assert got[305].evidence and {"vileword", "nastyword"} <= set(got[305].terms)
    assert {r.doc_id for r in toxicity.keep_clean(docs, index).collect()} == {i for i, _, y in rows if not y}


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 0), (None, 1), (7, None), (1, 1)], "doc_id long, toxic int")
    for l in (labels, labels.limit(0), labels.where("toxic = 0")):
        rows = toxicity.scored(odd, toxicity.fit(odd, l)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(empty, toxicity.fit(odd, labels)).count() == 0


RULES = [url_filter.Rule.parse(v, t) for v, t in (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/"))]
URLS = ["http://A.Example.com/en/71?x", "https://b.com/en/", "https://b.com/fr/", "x://net/", "x://net", "http://a.net/q#f", "no scheme", "", None, "http://badhost.org/z", "http://com/en/?://", "http://good.org/z/y?k=v"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, `rule` int, host int")
    labelled = spark.createDataFrame([(f"http://badhost.org/{i}", True) for i in range(40)] + [(f"http://good{i % 3}.org/{i}", False) for i in range(60)] + [(None, True)], "url string, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(pages.select("page_id", "url"), RULES, url_filter.mine(labelled)).collect()}
    for i, u in enumerate([*URLS, URLS[0]]):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest).group()
            path, host = re.match("[^?#]*", rest[len(host) :]).group(), host.lower()
        fits = [(len(r.text), r.text, r.verdict) for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if host == "badhost.org" else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    none = url_filter.judge(pages.select("page_id", "url"), [], url_filter.mine(labelled.limit(0)))
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_a_host_of_many_labels_costs_no_more_than_its_length(spark):
    hosts = ["a." * 60_000 + "net", "a." * 60_000 + "nets", "b.example.com", "com", ".com", "xcom"]
    pages = spark.createDataFrame([(i, f"x://{h}/en/7") for i, h in enumerate(hosts)], "page_id long, url string")
    none = url_filter.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = {r.page_id: (r.n, r.rule) for r in url_filter.judge(pages, RULES, none).selectExpr("page_id", "length(host) n", "rule").collect()}
    assert got == {i: (len(h), rule) for i, (h, rule) in enumerate(zip(hosts, ["net/", None, "example.com/en/7", "com/en/", "com/en/", None], strict=True))}


def test_mined_rules_decide_by_either_index(spark, empty):
    """Labels that follow a combination of tokens; every URL is judged as by all rules in plain Python."""
    labelled = [(f"http://h{i % 7}.{'bad' if i % 3 == 0 else 'ok'}.com/{'buy' if i % 2 else 'news'}/{i}?k=1", i % 3 == 0 and i % 2 == 1) for i in range(600)] + [("http://x.com/", None), (None, True)]
    mined = url_filter.mine(spark.createDataFrame(labelled, "url string, bad boolean")).persist()
    rules = [(-r.confidence, -r.support, len(r.antecedent), " ".join(r.antecedent), r.verdict, set(r.antecedent)) for r in mined.collect()]
    assert any(r[4] == "block" and r[5] <= {"label:bad", "path:buy"} for r in rules)
    assert not any(a[4] == b[4] and a[5] < b[5] and a[0] <= b[0] and len(b[5] - a[5]) == 1 for a in rules for b in rules)
    urls = [u for u, _ in labelled] + ["http://new.bad.com/buy/x", "http://new.bad.com/news/x", "http://new.ok.com/buy/" + "y" * 50_000]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, matched string")
    tokens = {r.url: set(r.t or []) for r in pages.select("url", url_filter.tokens_of(F.col("url")).alias("t")).collect()}
    for most in (2_000, 1):
        got = {r.page_id: r for r in url_filter.judge(pages, [], mined, max_mined=most).collect()}
        for i, u in enumerate(urls):
            first = min((r[:5] for r in rules if r[5] <= tokens[u]), default=None)
            assert (got[i].verdict, got[i].matched) == ((first[4], first[3]) if first else ("allow", None)), u
    assert got[602].verdict == "block" and got[603].verdict == "allow"
    assert url_filter.judge(pages.limit(0), RULES, mined).count() == 0


def passages(text, length):
    return set(re.findall(f"[^\n]{{1,{length}}}", text))


def passage(text):
    return max(8, 2 ** math.ceil(math.log2(max(1, len(text)) / 8))) if len(text) > 8 else 8


def likeness(s, t):
    n = max(passage(s), passage(t))
    a, b = passages(s, n), passages(t, n)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("bucket", [1, 512])
def test_fingerprints_of_versions(spark, odd, empty, monkeypatch, bucket):
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", (None, None, bucket))
    source = [r for r in ODD if r[0] is not None]
    source = sorted(dict.fromkeys((i, t or "") for i, t, *_ in source), key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprint.versions(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert len(got) == len(source)
    for (i, t), (_, nxt) in zip(source, [*source[1:], source[0]], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert got[i].n_chars == len(t)
        assert got[i].near_edited == pytest.approx(likeness(t, edited)) and got[i].near_next == pytest.approx(likeness(t, nxt)), i
    assert fingerprint.versions(empty).count() == 0
    assert fingerprint.versions(odd).count() == len(ODD)


def test_small_changes_keep_texts_alike(spark, odd, empty):
    """Single-line texts of two sizes whose edited version differs in a few characters; all else is new."""
    import random

    rng = random.Random(1)
    made = [" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n)) for n in (1500, 400)] + ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3000))]
    rows = []
    for k, t in enumerate(made):
        changed = list(t)
        for at in (60, len(t) // 2, len(t) - 40):
            changed[at : at + 1] = "zz"  # what follows is shifted
        rows.append((k, t, "".join(changed)))
    df = spark.createDataFrame(rows, "k int, t string, u string")
    df = df.withColumns({"a": F.expr(fingerprint.pieces_sql("t")), "b": F.expr(fingerprint.pieces_sql("u"))}).withColumns({"a_cells": F.expr(fingerprint.cells_sql("a")), "b_cells": F.expr(fingerprint.cells_sql("b"))})
    df = df.withColumn("c", F.expr(fingerprint.compared_sql("t", "u", "a", "b", True)))
    for r in df.select("a", "b", F.expr(fingerprint.likeness_sql("c")).alias("got")).collect():
        a, b = set(r.a), set(r.b)
        assert r.got == pytest.approx(len(a & b) / len(a | b)) and r.got > 0.6 and len(a) > 8
    two = spark.createDataFrame([(1, made[0]), (2, made[0] * 9)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.versions(two, by_content=True).collect()}
    assert got[1].near_next == got[2].near_next > 0.9  # of different lengths, cut alike
    assert fingerprint.versions(empty, by_content=True).count() == 0
    assert fingerprint.versions(odd, by_content=True).count() == len(ODD)


def test_difference_is_recovered_at_every_size(spark):
    """Sets that differ in 0 to 3000 digests: first tables, groups and larger retries."""
    rows = [(k, list(range(1, 500)), list(range(1 + k, 500 + 2 * k))) for k in (0, 1, 5, 40, 300, 1500)]
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>").selectExpr("k", "transform(a, x -> xxhash64(x)) a", "transform(b, x -> xxhash64(x)) b")
    df = df.withColumns({"ca": F.expr(fingerprint.cells_sql("a")), "cb": F.expr(fingerprint.cells_sql("b"))}).withColumn("d", F.expr(fingerprint.difference_sql("a", "b", "ca", "cb")))
    for r in df.collect():
        assert sorted(r.d.a) == sorted(set(r.a) - set(r.b)) and sorted(r.d.b) == sorted(set(r.b) - set(r.a))


def test_blocks_of_a_conversation_decode_as_one(spark, monkeypatch):
    rows = [(c, t, ["user", "assistant"][t % 2], ("Why so? " if t % 2 == 0 else "Because of this. " * (3 + t % 5))) for c in range(30) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(df)
    whole = {(r.conv_id, r.turn): r.role_pred for r in chat.recover(df, model).collect()}
    monkeypatch.setattr(chat, "BLOCK", 3)
    assert {(r.conv_id, r.turn): r.role_pred for r in chat.recover(df, model).collect()} == whole
    assert all(whole[c, t] == role for c, t, role, _ in rows)


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", "User: hi?"), (1, 1, "assistant", "Assistant: hello\n- a\n- b"), (1, 1, None, None), (None, 0, "user", ""), (2, None, "system", "x"), (2, None, "system", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rendered(chat.recover(df, chat.fit(df))).collect()
    assert len(got) == len(rows)
    assert any(r.rendered == "<|user|>\nhi?\n<|end|>" for r in got)
    assert chat.recover(df.limit(0), chat.fit(df.limit(0))).count() == 0
    assert {r.role_pred for r in chat.recover(df, chat.fit(df.limit(0))).collect()} == {"user"}
    cut = chat.utterances(spark.createDataFrame([(1, "User: a\nb\nAssistant: c\n\nd")], "conv_id long, text string")).collect()
    assert [r.text for r in cut] == ["User: a\nb", "Assistant: c", "d"]


def test_viterbi_is_that_of_all_paths(spark):
    import itertools

    roles = ["assistant", "system", "user"]
    rows = [(c, t, roles[(c + t) % 3 if t < 2 else t % 3], "Why? " * (1 + (c * t) % 4) + ("\n- x" if (c + t) % 5 == 0 else "")) for c in range(12) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(df)
    seen = chat.observed(df).toPandas().sort_values(["conv_id", "turn"]).reset_index(drop=True)
    e, got = model.emissions(seen), {(r.conv_id, r.turn): r.role_pred for r in chat.recover(df, model).collect()}
    for c in range(12):
        own = e[c * 6 : c * 6 + 6]
        score = lambda p: model.start[p[0]] + own[0, p[0]] + sum(model.step[a][b] + own[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))  # noqa: B023, E731
        best = max(map(score, itertools.product(range(3), repeat=6)))
        path = [model.roles.index(got[c, t]) for t in range(6)]
        assert score(path) == pytest.approx(best)


def test_transcripts_are_cut_and_rendered_without_loss(spark):
    text = "User: is a > b?\nmore\nAssistant: Question: why <|end|> and <\\|x|>?\nnot: a marker"
    rows = spark.createDataFrame([(1, 0, text), (1, 1, "a > b holds"), (2, 0, "x" * 200_000)], "conv_id long, turn long, text string")
    cut = chat.utterances(rows, turn_col="turn", blank_lines=False)
    assert [r.text for r in cut.where("conv_id = 1 and turn = 0").orderBy("part").collect()] == ["User: is a > b?\nmore", "Assistant: Question: why <|end|> and <\\|x|>?\nnot: a marker"]
    teach = spark.createDataFrame([(c, t, ["user", "assistant"][t % 2], ["User: hm?", "Assistant: so it is"][t % 2]) for c in range(20) for t in range(4)], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn, r.part): r for r in chat.rendered(chat.recover(cut, chat.fit(teach))).collect()}
    assert [got[1, 0, p].role_pred for p in (0, 1)] == ["user", "assistant"]
    for k, r in got.items():
        body = r.rendered.split("\n", 1)[1].removesuffix("\n<|end|>")
        assert r.marker + re.sub(r"<\\(\\*)\|", r"<\1|", body) == r.text, k
        assert "<|" not in body
    odd = spark.createDataFrame([(None, 1, "a", 9), (None, 1, "a", 9), (1, None, None, 9)], "conv_id long, turn long, text string, block int")
    assert chat.recover(odd, chat.fit(teach)).count() == 3
