"""The ten operators and the pipeline against brute force, on small hostile tables."""

import base64
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from lapforge.llm import bpe, common, html_text, kneser_ney, mixing, ngram_join, phrases, pstable, quality_rules, queries, resampling, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus():
    """Texts with copies, near copies, shared passages, nulls, empties, odd spaces and a long one."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeéñü") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, texts = say(60), []
    for i in range(60):
        texts.append(" ".join(say(rng.randint(1, 120))))
    base = say(150)
    for i in range(25):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 10 + [" ".join(say(30) + passage + say(rng.randint(0, 40))) for _ in range(12)]
    texts += [None, "", " \t\n\x0b\f\r ", "x", "One two THREE four", "one  two\nthree\tfour", "a b c d e", "A B c d E", "é" * 700, "ab " * 400, "　wide　", "𝔘𝔫𝔦 code 🚗🚗", "line one is here\nline one is here\nother\n\nother"]
    texts.append(" ".join(say(6000)))
    rng.shuffle(texts)
    return [(i * 3 % 1009, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # columns whose names clash with those that the operators compute
    return df.withColumns({c: F.lit("x") for c in ("id", "n", "size", "target", "ids", "kept", "score", "t", "g", "shard", "log_weight", "n_words")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_bpe_equals_tiktoken_and_round_trips(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    plain = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={})
    coded = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, outputs=("ids", "n_tokens", "decoded_sha256"))
    got = {r["doc_id"]: r for r in bpe.decode(coded, ranks, public_tokenizers.PATTERN).collect()}
    for i, t, *_ in rows:
        ids = lib.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert bytes(got[i]["decoded"]) == (t or "").encode()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_ngram_join_components(docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert ngram_join.components(empty).count() == 0


def test_quality_base_counts(docs, rows, empty):
    got = {r["doc_id"]: r for r in quality_rules.distribution_rules(docs).collect()}
    for i, t, *_ in rows:
        w, t = words(t), t or ""
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.distribution_rules(empty).count() == 0


def test_quality_verdict_on_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality_rules.distribution_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    good = got.where("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good == 1.0


def test_quality_rejects_labelled_junk_by_words(spark):
    d = "/root/testdata/sf0.01"
    got = quality_rules.distribution_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    junk = got.where("quality = 0 and not base_failed").collect()
    assert sum(r["kept"] for r in junk) <= 0.1 * len(junk) and len(junk) > 20
    assert all(r["word_distance"] > 0.3 for r in junk if r["main_lang"] is None)
    assert any(not r["kept"] and r["char_distance"] <= quality_rules.MAX_CHAR_DISTANCE for r in junk)


def test_quality_distances_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    texts |= {-1: " ".join(f"zz{i}" for i in range(60)), -2: " ".join(f"zz{i}" for i in range(40)), -3: "the of and " + " ".join(f"zz{i}" for i in range(120)), -4: ""}
    got = {r["doc_id"]: r for r in quality_rules.distribution_rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    lists, lang, share = quality_rules.COMMON_WORDS, {}, {}
    for i, t in texts.items():
        low = [w.lower() for w in words(t)]
        hits = {k: sum(w in ws for w in low) for k, ws in lists.items()}
        lang[i] = max(hits, key=hits.get) if any(hits.values()) else None
        if lang[i] and len(low) >= quality_rules.MIN_WORDS:
            counts = [low.count(w) for w in lists[lang[i]]]
            share[i] = np.array([*counts, len(low) - sum(counts)]) / len(low)
    refs = {k: np.mean([share[i] for i in share if lang[i] == k and not got[i]["base_failed"]], axis=0) for k in lists if any(lang[i] == k and not got[i]["base_failed"] for i in share)}

    def distance(p, q):
        half = lambda a: sum(x * math.log2(x / m) for x, m in zip(a, (p + q) / 2) if x > 0) / 2
        return math.sqrt(max(half(p) + half(q), 0))

    none = min(distance(np.eye(len(q))[-1], q) for q in refs.values())
    for i, t in texts.items():
        want = distance(share[i], refs[lang[i]]) if i in share and lang[i] in refs else none if lang[i] is None and len(words(t)) >= 50 else None
        r = got[i]
        assert r["main_lang"] == lang[i] and (r["word_distance"] is None) == (want is None), i
        assert want is None or math.isclose(r["word_distance"], want, abs_tol=1e-7), i
        far = (want or 0) > quality_rules.MAX_WORD_DISTANCE or (r["char_distance"] or 0) > quality_rules.MAX_CHAR_DISTANCE
        assert r["kept"] == (not r["base_failed"] and not far)
    assert not got[-1]["kept"] and not got[-3]["kept"]


def test_kneser_ney(spark, docs, rows, empty):
    out = {r["doc_id"]: r for r in kneser_ney.score_documents(docs).collect()}
    train = [(t or "") for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10 != 0]
    toks = lambda t: [*words(t.translate(LOWER)), None]
    uni, pair = Counter(), Counter()
    for t in train:
        s = toks(t)
        uni.update(s)
        pair.update(zip(["<s>", *s], s))
    n, v = sum(uni.values()), len(uni)

    def discounts(counts):
        k = Counter(counts)
        y = k[1] / (k[1] + 2 * k[2]) if k[1] and k[2] else 0.5
        d = [0.0, 1 - 2 * y * k[2] / k[1] if k[1] and k[2] else 0.5, 2 - 3 * y * k[3] / k[2] if k[2] and k[3] else 0.5, 3 - 4 * y * k[4] / k[3] if k[3] and k[4] else 0.5]
        return [0.0] + [d[i] if 0.05 <= d[i] <= i else 0.5 for i in (1, 2, 3)]

    cont = Counter(w for _, w in pair)
    total, follow = Counter(), {}
    for (a, b), c in pair.items():
        total[a] += c
        follow.setdefault(a, Counter())[min(c, 3)] += 1
    high, low = discounts(pair.values()), discounts(cont.values())
    types = sum(cont.values())
    gamma0 = sum(low[min(c, 3)] for c in cont.values()) / types
    lower = lambda w: max(cont[w] - low[min(cont[w], 3)], 0) / types + gamma0 / (v + 1)

    def prob(a, w):
        if not total[a]:
            return lower(w)
        g = sum(high[k] * m for k, m in follow[a].items()) / total[a]
        c = pair[a, w]
        return max(c - high[min(c, 3)], 0) / total[a] + g * lower(w)

    for i, t, *_ in rows:
        s, r = toks(t or ""), out[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(s), sum(uni[w] > 0 for w in s))
        assert math.isclose(r["base_score"], sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(prob(a, w)) for a, w in zip(["<s>", *s], s)), rel_tol=1e-9)
    some = rng_context = next(iter(follow))
    assert math.isclose(sum(prob(rng_context, w) for w in uni) + prob(some, object()), 1.0, rel_tol=1e-9)
    assert kneser_ney.score_documents(empty).count() == 0


def test_html(spark):
    pages = [
        (1, "http://h.com/1", "<html><head><title>x</title></head><body><nav>Menu</nav><article><h1>T &amp; U</h1><p>One\n two<p>Three<script>no</script></article><footer>f</footer></body>"),
        (2, "http://h.com/2", None), (3, None, ""), (4, "http://h.com/4", "<p>loose <b>text</b></p><div class='cookie-notice'>c</div>"),
    ]
    junk = "<p>this very long site wide banner says the same thing on all pages</p>"
    pages += [(10 + i, "http://q.org/%d" % i, f"{junk}<p>unique words number {i} live on page {i} only here</p>") for i in range(5)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == ("T & U\nOne two\nThree", 19) and got[2] == ("", 0) and got[3] == ("", 0) and got[4][0] == "loose text"
    assert all(got[10 + i][0] == f"unique words number {i} live on page {i} only here" for i in range(5))


def test_html_repeats_inside_and_beside_articles(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(999)) for _ in range(n))
    notice, beside, copy, want, pages = say(12), say(10), [say(15), say(15)], {}, []
    for i in range(6):  # a notice in the article and a line beside it, both of no listed class
        own = [say(20), say(9)]
        pages.append((i, "http://a.org/%d" % i, f"<div>{beside}</div><article><p>{own[0]}</p><div>{notice} u{i}</div><p>{own[1]}</p></article>"))
        want[i] = "\n".join(own)
    for i in range(6, 10):  # copies of one article keep it
        pages.append((i, "http://a.org/%d" % i, f"<div>{beside}</div><main><p>{copy[0]}</p><p>{copy[1]}</p></main>"))
        want[i] = "\n".join(copy)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract(df).collect()} == want


def test_html_pages_of_a_run_are_counted_over_all_partitions(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(9999)) for _ in range(n))
    notices, pages, want = {n: say(12) for n in (2, 3, 5)}, [], {}
    on = {i: n for n, at in ((2, (3, 31)), (3, (0, 17, 39)), (5, (1, 9, 20, 28, 36))) for i in at}
    for i in range(40):
        own, notice = say(20), notices.get(on.get(i))
        pages.append((i, "http://b.org/%d" % i, f"<p>{own}</p>" + (f"<p>{notice}</p>" if notice else "")))
        want[i] = own + (f"\n{notice}" if on.get(i) == 2 else "")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for parts in (1, 3, 40):
        assert {r["page_id"]: r["text"] for r in html_text.extract(df.repartition(parts)).collect()} == want


def test_host_suffix_array_against_counting():
    rng = random.Random(1)
    token, page = [], []
    for p in range(6):
        s = [rng.randint(1, 3) for _ in range(80)]
        token += s
        page += [p] * len(s)
    suffix, interval = html_text.host_runs(np.array(token), np.array(page), 6)
    runs = {}
    for i, k in zip(suffix.tolist(), interval.tolist()):
        runs.setdefault(k, []).append(i)
    want = {}
    for i in range(len(token) - 5):
        if page[i] == page[i + 5]:
            want.setdefault(tuple(token[i : i + 6]), []).append(i)
    assert sorted(map(sorted, runs.values())) == sorted(want.values())
    assert [token[suffix[0] :][:6], *[token[i:][:6] for i in suffix]] == sorted([token[suffix[0] :][:6], *[token[i:][:6] for i in suffix]])


def test_html_repeated_runs_against_brute_force(spark):
    """Pages without any markup but paragraphs: a paragraph goes from half of repeated words on."""
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(40)]
    phrases_ = [[rng.choice(vocab) for _ in range(rng.randint(6, 14))] for _ in range(30)]
    rows = []
    for i in range(90):
        paragraphs = [sum((rng.choice(phrases_) if rng.random() < 0.4 else [rng.choice(vocab) for _ in range(rng.randint(1, 12))] for _ in range(2)), []) for _ in range(rng.randint(0, 6))]
        rows.append((None if i % 30 == 7 else i, "https://%s.net/x" % "abc"[i % 3] if i % 9 else None, "".join(f"<p>{' '.join(p)}</p>" for p in paragraphs), "x"))
    rows += rows[:4] + [(500, "http://a.net", "<p>" + " ".join(rng.choice(vocab) for _ in range(30_000)) + "</p>", "x"), (501, "http://a.net", None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(7)
    host = lambda u: (u or "//").split("/")[2] if u else ""
    seen = {}
    streams = [[re.findall(r"<p>(.*?)</p>", h or ""), host(u), (p, h if p is None else None)] for p, u, h, _ in rows]
    for ps, h, page in streams:
        w = " ".join(ps).split()
        for k in range(len(w) - 7):
            seen.setdefault((h, *w[k : k + 8]), set()).add(page)
    want, dropped = Counter(), 0
    for (p, u, _, _), (ps, h, _) in zip(rows, streams):
        w = " ".join(ps).split()
        gone = [False] * len(w)
        for k in range(len(w) - 7):
            if len(seen[(h, *w[k : k + 8])]) >= 3:
                gone[k : k + 8] = [True] * 8
        at, kept = 0, []
        for x in ps:
            n = len(x.split())
            hit = sum(gone[at : at + n])
            at += n
            if x and (2 * hit < n):
                kept.append(x)
            dropped += bool(hit)
        want[p, u, "\n".join(kept), len("\n".join(kept))] += 1
    assert Counter(tuple(r) for r in html_text.extract(df).collect()) == want and dropped > 20


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>real</p><article class='comment'><p>me too</p></article></article>", "real"),
        ("<article><p>real</p></article><article class='comment'>me too</article>", "real"),
        ("<article><p>one</p></article><article><p>two</p></article>", "one\ntwo"),
        ("<main><p>real text</p><article>teaser</article></main>", "real text\nteaser"),
        ("<article><p id='share-price'>a</p><p class='ad-hoc'>b</p><div class='share-buttons'>c</div></article>", "a\nb"),
        ("<body><nav><a>Home</a><article><p>text</p></article></body>", "text"),
        ("<ul><li class=comment>x<li class=comment>y</ul><p>z", "z"),
        ("<title>t<p>after</p>", "t\nafter"),
        ("<p>a < b & c &lt; d</p><!-- no", "a < b & c < d"),
        ("<p title='x>y'>in</p><p title='>out</p>", "in\nout"),
        ("<p>a\u00a0 \n b</p>\n<pre>c</pre>", "a b\nc"),
        (None, ""), ("", ""), ("plain", "plain"), ("</p></nav>x", "x"),
        ("<form><h1>Head</h1><p>the page lies in a form</p><select><option>x</select></form>", "Head\nthe page lies in a form"),
        ("<form><p>mail</p><article><p>in a form</p></article></form>", "in a form"),
        ("<p>a page with more text than its form</p><form><p>mail me</p></form>", "a page with more text than its form"),
        ("<article class='container'><article><p>inner text</p></article></article>", "inner text"),
        ("<article><article><p>one</p></article><article><p>two</p></article></article>", "one\ntwo"),
        ("<div class='promo'><main><p>m</p></main></div>", "m"),
    ],
)
def test_html_blocks(page, text):
    got = html_text.blocks(page)
    marked = [t for t, i in got if i & html_text.MARKED]
    assert "\n".join(marked or [t for t, _ in got]) == text


def test_html_titles_beside_marked_text(spark):
    """A unique h1 beside an article stays however short; one that its neighbours' runs repeat on three pages goes."""
    say = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    site = "<div><h1>The site</h1><p>welcome to our daily news and more of it</p></div>"
    pages = [(i, "http://h/", f"{site}<h1>Story {i}</h1><article><p>{say(i)}</p></article>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}\n{say(i)}" for i in range(4)}


@pytest.mark.parametrize("piece", ["<a ", "<a<", "<!--", '<a "', "<title>", "<div>", "<p class='", "</div>", "<b></i>", "&amp;", "<nav>x"])
def test_html_scan_is_linear(piece):
    began = time.process_time()
    html_text.blocks(piece * (2_000_000 // len(piece)))
    assert time.process_time() - began < 20


@pytest.mark.parametrize("n", [40, 1500])
def test_neighbours(spark, n):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 12)) * rng.uniform(0.5, 2, (n, 1))
    x[30] = x[31] = x[32]
    data = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * 12), (n + 2, [float("nan")] * 12), (n + 3, [None] * 12), (n + 4, [1.0]), (20 * n, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = pstable.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    hits = 0
    for q in range(0, n, 20):
        s = np.einsum("ij,j->i", x, x[q])
        s[q] = -np.inf
        want = np.lexsort((np.arange(n), -s))[: min(20, n - 1)]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert all(math.isclose(m[2], s[m[1]], rel_tol=1e-12) for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len(set(want) & {m[1] for m in mine}) / len(want)
    assert hits / len(range(0, n, 20)) >= (0.9 if n > 1000 else 1.0)


def test_phrase_automata(docs, rows, empty):
    got = {r["doc_id"]: r for r in phrases.remove_repeats(docs).collect()}
    seen = set()
    for i, t, *_ in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g)), i
    assert phrases.remove_repeats(empty).count() == 0


def test_phrase_automata_decide(docs, monkeypatch):
    """Without matches nothing is marked but copies inside one task; small automata and one task give the same."""
    mark = lambda: phrases.remove_repeats(docs).agg(F.sum("n_removed"), F.sum(F.xxhash64("doc_id", "kept_text") % 1000003)).first()
    full = mark()
    monkeypatch.setattr(phrases, "marks", lambda t, a, w, n, whole=phrases.marks: whole(t, a, w, 3, patterns=5))
    assert mark() == full and full[0] > 0
    monkeypatch.setattr(phrases, "_marks", lambda *_: [np.zeros(0, t) for t in (np.uint64, np.int64, np.int32, np.int64)])
    assert phrases.remove_repeats(docs.repartition(60)).agg(F.sum("n_removed")).first()[0] < 0.5 * full[0]


def test_phrase_repeated_ids_nulls_and_places_in_one_text(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(n))
    p, q = say(30), say(22)
    rows = [(4, f"{p} x {p} {q}"), (4, f"{p} y"), (4, p), (1, f"y {p} 1"), (3, f"z {q}"), (None, f"{p} {q}"), (None, None), (8, ""), (9, f"{p}\n{p}\t{p}"), (9, say(4000) + " " + q)]
    rows += [(100 - i, say(5) + " " + p) for i in range(9)] + [(9, f"{p}\n{p}\t{p}")]
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 19):
            x, at = tuple(w[k : k + 20]), (i is None, i or 0, k)
            first[x] = min(first.get(x, at), at)
    want = Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (i is None, i or 0, k):
                gone[k : k + 20] = [True] * 20
        want[i, len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g)] += 1
    for parts in (1, 6):
        df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, row string").repartition(parts)
        assert Counter(tuple(r) for r in phrases.remove_repeats(df).collect()) == want


def test_suffix_dedup(docs, rows, empty):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    seen = set()
    for i, t, *_ in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = [True] * 50
        seen |= {b[k : k + 50] for k in range(len(b) - 49)}
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)), i
    assert suffix_dedup.remove_repeats(empty).count() == 0


def _parts(strings, per, depth):
    """Transforms of groups of strings one after the other, and the rank of each suffix."""
    symbols, backs, where, base = [], [], {}, 0
    for k in range(0, len(strings), per):
        group = strings[k : k + per]
        symbol, back, string, offset = suffix_dedup.shard_bwt(np.frombuffer(b"".join(group), np.uint8), np.array([len(s) for s in group]), depth)
        suffixes = [group[s][o:] for s, o in zip(string, offset)]
        assert [x[:depth] for x in suffixes] == sorted(x[:depth] for x in suffixes)
        assert all(o == 0 or group[s][o - 1] == c for s, o, c in zip(string, offset, symbol))
        assert all(o == 0 or (string[b], offset[b]) == (s, o - 1) for s, o, b in zip(string, offset, back))
        where |= {(k + s, o): base + i for i, (s, o) in enumerate(zip(string.tolist(), offset.tolist()))}
        symbols.append(symbol)
        backs.append(back + base)
        base += len(symbol)
    return np.concatenate(symbols), np.concatenate(backs), where


@pytest.mark.parametrize("per", [1, 7, 40])
def test_merged_transforms_find_every_repeated_string(per):
    rng = random.Random(9)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(6, 20))) for _ in range(40)]
    depth = 6
    symbol, back, where = _parts(strings, per, 20)
    starts = [(s, o) for s, x in enumerate(strings) for o in range(len(x) - depth + 1)]
    rank = np.array([where[s, o + depth] for s, o in starts])
    place = {r: k for k, r in where.items()}
    got, interval, alone, steps = suffix_dedup.merge_bwts(symbol, back, rank, np.zeros(len(rank), np.int64), depth)
    groups = {}
    for r, i in zip(got.tolist(), interval.tolist()):
        groups.setdefault(i, []).append(place[r])
    want = {}
    for s, o in starts:
        want.setdefault(strings[s][o : o + depth], []).append((s, o))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    single = sorted((place[r][0], place[r][1] - k) for r, k in zip(alone.tolist(), steps.tolist()))
    assert single == sorted(v[0] for v in want.values() if len(v) == 1)


def test_more_sources_than_sixteen_bits():
    strings = [b"%06d" % i for i in range(70_000)]  # one transform a string, 7 ranks each
    n = len(strings)
    data = np.frombuffer(b"".join(strings), np.uint8).reshape(n, 6)
    symbols = np.concatenate([np.zeros((n, 1), np.uint8), data], axis=1)[:, ::-1].ravel()  # of ranks ordered from the end
    base = np.arange(n)[:, None] * 7
    backs = (base + np.minimum(np.arange(7) + 1, 6)).ravel()
    got, interval, alone, _ = suffix_dedup.merge_bwts(symbols, backs, (base[:, 0]), np.zeros(n, np.int64), 6)
    assert len(got) == 0 and sorted((alone // 7).tolist()) == list(range(n))


def test_suffix_dedup_removes_nothing_without_the_transforms(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "shards_for", lambda *_: 2)
    full = suffix_dedup.remove_repeats(docs).agg(F.sum("n_removed")).first()[0]
    whole = suffix_dedup._repeats

    def blind(texts, anchors, length, n_shards):
        units = whole(texts, anchors, length, n_shards)
        for s, n in units.sizes.items():
            for name in ("again", "mask"):
                np.zeros(n, np.uint64).tofile(os.path.join(units.base.removeprefix("file:"), f"{s}.{name}"))
        return units

    monkeypatch.setattr(suffix_dedup, "_repeats", blind)
    assert full > 0 and suffix_dedup.remove_repeats(docs).agg(F.sum("n_removed")).first()[0] == 0


def test_suffix_dedup_repeated_ids_hot_anchors_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)  # most anchors of this table are hot
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line, other = say(120), say(90)
    rows = [(5, line + say(40)), (5, other), (5, line), (6, say(30) + line + other), (7, other[:70] + say(9)), (None, line), (None, None), (9, ""), (9, "x" * 400), (10, "x" * 60)]
    rows += [(20 + i, say(25) + line + say(25)) for i in range(12)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n_bytes int, id string").repartition(3)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"]), r["id"]) for r in suffix_dedup.remove_repeats(df, carry=("n_bytes", "id")).collect())
    by_id, want = {}, Counter()
    for i, t in rows:
        by_id.setdefault(i, set()).update({(t or "").encode()[k : k + 50] for k in range(len((t or "").encode()) - 49)})
    rank = lambda i: (i is None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if any(b[k : k + 50] in s for j, s in by_id.items() if rank(j) < rank(i)):
                gone[k : k + 50] = [True] * 50
        want[i, len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g), "c"] += 1
    assert got == want


def test_resampling(spark, docs, empty):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = resampling.resample(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id")
    kept = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.9 and kept[0] < 0.2
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resampling.resample(docs, none).where("kept").count() == docs.count()
    assert resampling.resample(empty, labels).count() == 0


@pytest.mark.parametrize("k", [0, 1, 37, 1000])
def test_gumbel_top_k_is_exact(spark, k):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("double").alias("score"))
    order = sorted(range(300), key=lambda i: (-(i % 7), i))
    got = {r["doc_id"] for r in df.where(resampling.top_k_rule(df, k, "doc_id")).collect()}
    assert got == set(order[:k])


def test_mix(docs, rows, empty):
    got = {r["doc_id"]: r for r in mixing.taken_words(docs).collect()}
    sizes, by = {i: len(words(t)) for i, t, *_ in rows}, {i: s for i, _, _, s, _ in rows}
    names = sorted({s for s in by.values() if s is not None}) + [None]
    weight = dict(zip(names, (5.0, 2.0, 1.0, 5.0)))
    total = {s: sum(n for i, n in sizes.items() if by[i] == s) for s in names}
    want, capped = {}, set()
    while True:  # plain water filling
        open_ = [s for s in names if s not in capped]
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * total[s]]
        if not over:
            break
        capped |= set(over)
    want = {s: 3.0 * total[s] if s in capped else level * weight[s] for s in names}
    taken = Counter()
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (sizes[i], total[by[i]]) and math.isclose(r["target"], want[by[i]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[by[i]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    assert {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs).collect()} == {i: r["taken"] for i, r in got.items()}
    assert mixing.taken_words(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "bpe_encoding":
            assert out.columns == docs.columns
        if name in ("quality_classifier", "ngram_jaccard_join"):
            assert out.join(docs, docs.columns, "left_anti").count() == 0
        docs = spark.createDataFrame(out.toPandas(), out.schema) if name != "bpe_encoding" else out
    assert docs.where("n_tokens <> size(ids)").count() == 0 and docs.count() > 0


def test_pipeline_mix_keeps_rows_without_id(spark):
    import corpus_pipeline

    # source a is far below its share, so the cap takes each of its rows three times; b and c share the rest 2 to 1
    rows = [(None if i % 2 else i, f"a{i} " + "x " * (3 + i), "en", "a", 1) for i in range(8)]
    rows += [(None if i % 3 else i, f"{s}{i} " + "y " * (20 + i % 7), "en", s, 1) for s, k in (("b", 100), ("c", 200)) for i in range(k, k + 60)]
    got = Counter(tuple(r) for r in corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert set(got) <= set(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    rest = sum(size.values()) - 3 * size["a"]
    passes = {"a": 3.0, "b": rest * 2 / 3 / size["b"], "c": rest / 3 / size["c"]}
    assert passes["b"] < 3
    for r in rows:
        assert math.floor(passes[r[3]]) <= got[r] <= math.ceil(passes[r[3]]), r
    for s in "abc":
        taken = sum(n * len(words(r[1])) for r, n in got.items() if r[3] == s)
        assert abs(taken - passes[s] * size[s]) <= 27  # no more than the one document that is cut


def test_kneser_ney_is_finite_where_texts_come_in_fours(spark):
    rows = [(1000 + i, f"a{i // 4} b{i // 4} c{i // 4}") for i in range(160)] + [(2000 + i, "a1 d e") for i in range(3)] + [(3000 + i, "a1 b2 c3 a1 zz") for i in range(30)]
    got = kneser_ney.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_ngram_join_keeps_no_prefixes_or_postings(spark, docs):
    at = f"{common.shared_dir(spark)}/lapforge"
    held = lambda: {n for n in (os.listdir(at) if os.path.isdir(at) else ()) if n.split("-")[0] in ("prefixes", "postings", "spread", "sets", "groups")}
    before = held()
    assert ngram_join.components(docs).count() == docs.count()
    left = {n for n in held() - before if not n.startswith("sets-") or not os.path.exists(f"{at}/{n}/_SUCCESS")}  # the index of the sets stays
    assert not left


def test_shingle_sets_of_odd_words():
    odd = ["a", "Z", "é", "x\x00", "x\x00\x00", "abcdefgh", "abcdefghi", "q" * 64, "q" * 65, "q" * 400, "q" * 399 + "r"]
    texts = [None, "", " \t", "a b", "A  B\n", *[" ".join(odd[i:] + odd[:i]) for i in range(len(odd))], *odd, " ".join(odd * 3)]
    wanted = []
    for t in texts:
        w = words((t or "").translate(LOWER))
        wanted.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    got = [s[ptr[i] : ptr[i + 1]].tolist() for s, ptr in ngram_join.shingle_sets(pa.array(texts), 5) for i in range(len(ptr) - 1)]
    assert [len(s) for s in got] == [len(s) for s in wanted] and all(s == sorted(set(s)) for s in got)
    assert all(len(set(a) & set(b)) == len(x & y) for a, x in zip(got, wanted) for b, y in zip(got, wanted))


def test_ngram_join_spreads_its_pairs_and_shuffles_no_postings(spark, monkeypatch):
    plans = {}

    def noted(f):
        def run(df, label):
            plans[label] = df._jdf.queryExecution().executedPlan().toString()
            return f(df, label)

        return run

    monkeypatch.setattr(ngram_join, "staged", noted(common.staged))
    monkeypatch.setattr(ngram_join, "staged_at", noted(common.staged_at))
    rows = [(i, f"{' '.join(f'w{j}' for j in range(60))} v{i % 3} x{i % 3} y{i % 3} z{i % 3}") for i in (1, 1, 2, 3, 3)]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1)]
    assert "Exchange" not in plans["postings"] and "REPARTITION_BY_NUM" in plans["links"]


def test_ngram_join_of_repeated_ids(spark):
    rng = random.Random(2)
    say = lambda: [rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(60)]
    a, b, near = say(), say(), lambda w: " ".join(w[:-1] + ["end"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a)), (7, near(b)), (8, " ".join(say())), (None, " ".join(a)), (8, None), (9, " ".join(a))]
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 5): 2, (6, 5): 1, (7, 5): 1, (8, 8): 2, (None, None): 1, (9, 5): 1})


def test_mix_of_repeated_and_missing_ids_reruns_alike(spark):
    rows = [(7 if i % 3 else None, "w " * (i % 11), "s%d" % (i % 2), i) for i in range(200)]
    df = lambda n: spark.createDataFrame(rows, "doc_id long, text string, source string, times int").repartition(n)
    runs = [Counter(tuple(r) for r in mixing.taken_words(df(n)).collect()) for n in (1, 5, 3)]
    assert runs[0] == runs[1] == runs[2] and sum(runs[0].values()) == 200


def test_bpe_vocabularies_do_not_mix(spark):
    df = spark.createDataFrame([("abab",)], "text string")
    one = {bytes([i]): i for i in range(256)} | {b"ab": 256}
    two = {bytes([i]): i for i in range(256)} | {b"ba": 256}
    for ranks, want in ((one, [256, 256]), (two, [97, 256, 98])) * 2:
        assert bpe.encode(df, ranks, r"\w+").first()["ids"] == want


def test_resampling_weights_against_counting(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgh" if i % 2 else "efghijkl") for _ in range(rng.randint(0, 60))), f"keep {i}", float(i)) for i in range(60)] + [(None, None, "n", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_weight string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    ratio, share = resampling.fit(docs, labels)
    feats = lambda t: Counter(words(t)) + Counter(zip(words(t), words(t)[1:]))
    raw, good = Counter(), Counter()
    for i, t, *_ in rows:
        raw += feats(t)
        good += feats(t) if i is not None and i % 2 else Counter()
    total = {k: math.log((good[k] + 20) / (raw[k] * sum(good.values()) / sum(raw.values()) + 20)) for k in raw}
    got = {r["doc_id"]: r for r in resampling.resample(docs, labels).collect()}
    assert share == 0.5
    for i, t, *_ in rows:  # few n-grams, so none share a bucket
        assert got[i]["n_grams"] == sum(feats(t).values())
        assert math.isclose(got[i]["log_weight"], sum(n * total[k] for k, n in feats(t).items()), abs_tol=1e-9)
    kept = Counter(tuple(r) for r in resampling.select(docs, labels).collect())
    assert kept == Counter(r for r in rows if got[r[0]]["kept"]) and 0 < len(kept) < len(rows)


@pytest.fixture(scope="module")
def small_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([*rows, (None, "no id " * 30, "en", None, 1)], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_registered_queries_against_brute_force(spark, rows, small_dir):
    from lapforge.llm import queries

    every = [*rows, (None, "no id " * 30, "en", None, 1)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={})
    one, seven, ten, seen, strings = Counter(), Counter(), Counter(), set(), set()
    for i, t, *_ in sorted(every, key=lambda r: (r[0] is None, r[0])):
        ids = lib.encode_ordinary(t or "")
        one[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())] += 1
        w, b = words(t), (t or "").encode()
        gone, cut = [False] * len(w), [False] * len(b)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(tuple(w[k : k + 20]))
        for k in range(len(b) - 49):
            if b[k : k + 50] in strings:
                cut[k : k + 50] = [True] * 50
        strings |= {b[k : k + 50] for k in range(len(b) - 49)}
        seven[i, len(w), sum(gone), sha(" ".join(a for a, g in zip(w, gone) if not g).encode())] += 1
        ten[i, len(b), sum(cut), sum(g and not p for g, p in zip(cut, [False, *cut])), sha(bytes(x for x, g in zip(b, cut) if not g))] += 1
    for name, want in (("op1_bpe_codec", one), ("op7_phrase_automata", seven), ("op10_suffix_dedup", ten)):
        assert Counter(tuple(r) for r in queries.QUERIES[name](spark, small_dir).collect()) == want, name


def test_pipeline_stages_on_hostile_tables(spark, small_dir):
    import corpus_pipeline

    names = ["times", "n_bytes", "kept", "log_weight", "score", "_row", "id", "component_id", "n_shingles", "source_size", "n"]
    base = spark.read.parquet(f"{small_dir}/documents.parquet")
    twins = spark.createDataFrame([(7000, "one text " * 20, "en", "s1", 1), (7000, "another body " * 30, "en", "s1", 1), (7000, "one text " * 20, "en", "s1", 1), (None, None, None, None, None)], SCHEMA)
    docs = base.unionByName(twins).withColumns({c: F.lit("x") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small_dir)
        if name != "bpe_encoding":
            assert out.columns == docs.columns and out.where("times = 'x' and n = 'x'").count() == out.count() > 0
            assert stage(spark, docs.limit(0), small_dir).count() == 0
        else:
            assert out.count() == docs.count()
        if name == "ngram_jaccard_join":
            assert out.where("doc_id = 7000").count() == 2 and out.where("doc_id is null").count() == 2
        if name == "suffix_array_dedup":
            assert out.count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_registered_queries_equal_their_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{table}.parquet')")
    got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    order = lambda x: x[sorted(want.columns)].sort_values(sorted(want.columns)).reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, check_exact=True)
