"""Operators on single texts, compared with plain versions; edge cases of every operator."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from sensorloom.llm import cap_filters, html_text, line_dedup, mixing, pieces, quality, revisits, shards, token_counts, weighted_minhash  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Columns that operators use inside, as names of the input.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, doc string, h1 int, size int, kept string, _text string"
LONG = "one two three four five six seven eight. " * 3000 + "x" * 50_000


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}", 1, "n", "d", 1, 2, "k", "t") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def edge(spark):
    """Null ids, texts and sources, empty, blank, very long and repeated texts, repeated rows."""
    plain = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = rows_of([plain, plain, "", None, "  \n\t", LONG, "\n\n", plain + " again", "é ß 日本\u0000x", "a"])
    rows += [rows[0], (None, plain, None, None, None, None, None, None, None, None, None), (None,) * 11]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "lines": lambda d: line_dedup.dedup_lines(d, min_docs=2),
    "first lines": lambda d: line_dedup.dedup_lines(d, min_docs=1, keep_first=True, keep=["lang"]),
    "shards": lambda d: shards.assign_shards(d, "doc_id", ["a", "b"], 101),
    "tokens": lambda d: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "pieces": lambda d: pieces.encode_pieces(d, public_tokenizers.path("piece_bpe_32k.model")),
    "quality": lambda d: quality.quality_rules(d),
    "mix": lambda d: mixing.contributions(d),
    "html": lambda d: html_text.extract_text(d, id_columns=("doc_id",), html_column="text"),
    "near": lambda d: weighted_minhash.near_texts(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_cases_give_one_row_per_row_and_empty_tables_give_none(spark, edge, empty, name):
    assert OPERATORS[name](edge).count() == edge.count()
    assert OPERATORS[name](empty).count() == 0


# --- quality ---

def plain_quality(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    top, later = [], []
    for n in range(2, 11):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        if n < 5:
            top.append(max(((k - 1) * sum(map(len, g)) for g, k in Counter(grams).items()), default=0))
            continue
        twice = {g for g, k in Counter(grams).items() if k > 1}
        if n == 5:
            inside = {i + k for i, g in enumerate(grams) if g in twice for k in range(n)}
        again = {i + k for i, g in enumerate(grams) if g in grams[:i] for k in range(n)}
        later.append(sum(len(words[i]) for i in again))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), top, later


def plain_verdict(text):
    n_words, chars, _, again, repeated, top, later = plain_quality(text)
    lines = [x.encode() for x in text.split("\n") if WORD.search(x)]
    again_bytes = sum(len(x) for i, x in enumerate(lines) if x in lines[:i])
    if n_words < 10 or 100 * repeated > 20 * n_words or again > 0.3 * len(lines) or again_bytes > 0.2 * sum(map(len, lines)):
        return False
    return all(c <= limit * chars for c, limit in zip(top + later, (0.20, 0.18, 0.16, 0.15, 0.14, 0.13, 0.12, 0.11, 0.10)))


def test_quality_equals_a_plain_version(spark):
    passage = " ".join(f"same{i:02}" for i in range(12))
    bodies = [" ".join(f"w{k}x{i:03}" for i in range(60)) for k in range(4)]
    texts = ["a b c d e " * 4 + "ü # x", "l1 w\nl1 w\n \n\nl1 w", "w " * 30, " ".join(f"w{i}" for i in range(50)) + " " + " ".join(f"w{i}" for i in range(20)),
             "x y z\n" * 3 + " ".join(f"v{i % 7}" for i in range(40)), "", "é" * 10, *bodies, f" {passage} ".join(bodies), f" {passage} ".join(bodies[:2]),
             " ".join(f"of the {i}" for i in range(30)), "\n".join(["one line"] * 4 + [f"line number {i} of this" for i in range(5)]), bodies[0] + "\n" + "\n".join(["rule " * 4] * 3)]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["top_chars"], r["later_chars"]) == plain_quality(text)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == plain_verdict(text), text
    assert {got[i]["kept"] for i in range(len(texts)) if not got[i]["base_failed"]} == {True, False}


def test_clean_prose_is_kept(spark):
    text = " ".join(f"word{i}" for i in range(400)) + ".\n" + " ".join(f"other{i}" for i in range(100))
    assert quality.quality_rules(spark.createDataFrame(rows_of([text]), SCHEMA)).first()["kept"]


@pytest.mark.parametrize("text,kept", [
    (" ".join(f"of the w{i}" for i in range(40)), False),  # two words again and again
    ("\n".join(["Read more here"] * 4 + [" ".join(f"{c}{i}" for c in "abcdefgh") for i in range(6)]), False),  # lines
    ("\n".join([" ".join(f"{c}{i}" for c in "abcdefgh") for i in range(20)] + ["Read more here"] * 2), True),
])
def test_a_text_that_passes_the_base_can_fail_the_method(spark, text, kept):
    row = quality.quality_rules(spark.createDataFrame(rows_of([text]), SCHEMA)).first()
    assert (row["base_failed"], row["kept"]) == (False, kept)


def test_query_and_pipeline_have_the_same_verdict(spark):
    import corpus_pipeline

    passage = " ".join(f"same{i:02}" for i in range(12))
    body = [" ".join(f"w{k}x{i:03}" for i in range(60)) for k in range(4)]
    thrice = f"{body[0]} {passage} {body[1]} {passage} {body[2]} {passage}"
    twice = f"{body[0]} {passage} {body[1]} {passage} {body[2]}"
    docs = spark.createDataFrame(rows_of([thrice, twice]), SCHEMA)
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert [(got[i]["base_failed"], got[i]["kept"]) for i in range(2)] == [(False, False), (False, True)]
    full = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "char_length(text) AS n_chars")
    assert [r["doc_id"] for r in corpus_pipeline.quality_stage(spark, full, "").collect()] == [1]


# --- tokens ---

TEXTS = ["Hello, it's we'll  two  spaces\n\n\nend ", "<|endoftext|>a <|endoftext|>", "日本語 naïve ½ 12,5", "՘ x", "", " ", "\u0085a ", "x" * 300, "a'S 's"]


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_counts.token_counts(spark.createDataFrame(rows_of(TEXTS), SCHEMA), path, limit=3).collect()}
    for i, text in enumerate(TEXTS):
        expected = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (expected, len(text.encode()), expected > 3)


def test_agreed_characters_are_cut_like_the_library():
    counter = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    for low, high in token_counts.AGREED:
        for c in map(chr, range(low, high + 1)):
            probe = f"a{c}a!{c}!1{c}1 {c} \n"
            spans = [probe[a:b] for _, (a, b) in counter.library.pre_tokenizer.pre_tokenize_str(probe)]
            assert counter.pattern.findall(probe) == spans, hex(ord(c))


def test_texts_of_all_scripts_go_through_the_shortcut(spark):
    counter = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["日本語のテキスト、です。", "مرحبا بالعالم 123", "שלום עולם, it's", "สวัสดีชาวโลก", "emoji 😀😃 and 👩‍👩‍👧 more 🇫🇷", "zero\u200bwidth → arrow ™",
             "mixed 日本 and the plain words of a text <|endoftext|> 漢字\n\n  end ", "हिन्दी में पाठ", "\u3000 \u2003x"]
    assert all(counter.outside.search(t) for t in texts)
    assert counter.count([t.encode() for t in texts]) == [len(counter.library.encode(t, add_special_tokens=False).ids) for t in texts]
    long = texts[6] * 50
    cuts = counter.library_cuts(long)
    assert sum(c in counter.whole for c in cuts) > 0.5 * len(cuts)  # counted without a merge
    assert counter.count([long.encode()]) == [len(counter.library.encode(long, add_special_tokens=False).ids)]


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE_OF_LONG_TEXT", 50)
    counter = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "some words, and more\n" * 40
    assert counter.count([text.encode()] * 2) == [len(counter.library.encode(text, add_special_tokens=False).ids)] * 2


# --- pieces ---

def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*TEXTS, "▁x▁▁y", "a" * 300 + " " * 70 + "b.c|d", "tab\tnull\u0000", "   ", "</s><s>", "\n \n"]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r["doc_id"]: r for r in pieces.encode_pieces(frame, path).collect()}
    short = {r["doc_id"]: r for r in pieces.encode_pieces(frame, path, digest=True).collect()}
    for i, text in enumerate(texts):
        ids = [*library.encode(text), 2]
        assert (got[i]["n_tokens"], got[i]["ids"], got[i]["decoded"]) == (len(ids), " ".join(map(str, ids)), library.decode(ids)), text
        assert got[i]["n_segments_differing"] == 0
        assert short[i]["ids_sha256"] == hashlib.sha256(got[i]["ids"].encode()).hexdigest()
        assert short[i]["decoded_sha256"] == hashlib.sha256(got[i]["decoded"].encode()).hexdigest()


def test_a_small_cache_gives_the_same_ids():
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [f"word{i} some thing{i % 7}, and it. {i}".encode() for i in range(300)]
    expected = model.encode(texts)
    model.segments.limit = 2000
    model.segments.clear()
    model.segments.held = 0
    assert [model.encode([t])[0][0] for t in texts] == expected[0] and len(model.segments) < 60


def test_token_ids_stand_beside_the_digests(spark):
    frame = spark.createDataFrame(rows_of([*TEXTS, None]), SCHEMA)
    for r in pieces.encode_pieces(frame, public_tokenizers.path("piece_bpe_32k.model"), digest=True, with_ids=True).collect():
        assert len(r["token_ids"]) == r["n_tokens"]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["token_ids"])).encode()).hexdigest()


def test_caches_of_other_operators_are_given_up():
    from sensorloom.llm import batches

    dropped = []
    batches.keep_only("a", lambda: dropped.append("a"))
    batches.keep_only("a", lambda: dropped.append("a"))
    assert dropped == []
    batches.keep_only("b", lambda: dropped.append("b"))
    assert dropped == ["a"] and list(batches.KEPT) == ["b"]
    cache = batches.BoundedCache(lambda keys: [k * 2 for k in keys], 1000)
    for i in range(100):
        cache.fill({f"k{i}", f"k{i + 1}"})
        assert cache[f"k{i}"] == f"k{i}" * 2 and len(cache) < 20


# --- html ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies, ok?</div>
<article><h1>Head &amp; line</h1><p>First  paragraph, with\n<a href="x">a link</a> &lt;here&gt;.<p>Second <b>one</b>, longer than the first; it has more words.
<script>var x = "</p>";</script><ul><li>item, one<li>item, two</ul></article>
<aside>Also read</aside><section id="comments"><p>I agree, totally, with all of this!</p></section><form><input value="q">Search</form><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == (
        "Head & line\nFirst paragraph, with a link <here>.\nSecond one, longer than the first; it has more words.\nitem, one\nitem, two")
    assert html_text.main_text("") == ""
    assert html_text.main_text("<p>cut off te<b") == "cut off te"
    assert html_text.main_text("<nav>only a menu</nav>") == ""


PARAGRAPHS = "".join(f"<p>Paragraph {i}, {'many words of running text, ' * 14}and its end.</p>" for i in range(10))
LOW_PARTS = {
    "list": ("<ul>" + "".join(f"<li>short item number {i}</li>" for i in range(6)) + "</ul>", [f"short item number {i}" for i in range(6)]),
    "table": ("<table><tr><th>Year<th>Sum<tr><td>2023<td>12</table>", ["Year", "Sum", "2023", "12"]),
    "quote": ("<blockquote><p>Less is more</p></blockquote>", ["Less is more"]),
    "caption": ("<figure><img src=x><figcaption>A plain caption</figcaption></figure>", ["A plain caption"]),
}


@pytest.mark.parametrize("part", LOW_PARTS)
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_low_paths_of_the_content_stay(part, around):
    inner, lines = LOW_PARTS[part]
    page = f"<html><body><div><ul><li>Elsewhere</ul></div><{around}><h1>Title</h1>{PARAGRAPHS}{inner}</{around}></body></html>"
    found = html_text.main_text(page).split("\n")
    assert found[0] == "Title" and found[11:] == lines


INNER = f"<h1>Title</h1>{PARAGRAPHS}"
FOOT = "<footer>Imprint</footer>"
WHOLE_PAGES = {
    "open head": f"<html><head><title>T</title><meta charset=utf-8><body>{INNER}{FOOT}</body></html>",
    "open head without body": f"<html><head><title>T</title>{INNER}{FOOT}</html>",
    "one form": f"<body><form action=x>{INNER}</form>{FOOT}</body>",
    "form around article": f"<body><form action=x><div>Log in</div><article>{INNER}</article></form>{FOOT}</body>",
    "sidebar class": f"<body><div class='content has-sidebar'>{INNER}</div><div class=sidebar>Side, with words.</div></body>",
    "header class": f"<body><div class=no-header>{INNER}</div><div class='site-footer'>Foot, with words.</div></body>",
    "nav class": f"<body><div class='with-nav'>{INNER}</div>{FOOT}</body>",
    "topic class": f"<body><div class='legal-news'>{INNER}</div>{FOOT}</body>",
    "named wrapper": f"<body><div id=share><article>{INNER}</article></div>{FOOT}</body>",
    "svg": f"<body><div><svg width='1'/></div>{INNER}<svg><title>t</title></svg>{FOOT}</body>",
    "math": f"<body><math/>{INNER}{FOOT}</body>",
}


@pytest.mark.parametrize("name", WHOLE_PAGES)
def test_no_page_is_lost_as_a_whole(name):
    found = html_text.main_text(WHOLE_PAGES[name]).split("\n")
    assert found[-11:][0] == "Title" and len(found) in (11, 12) and found[-1].startswith("Paragraph 9")


@pytest.mark.parametrize("other", [
    "<div class='comment-list'>I agree, totally.</div>", "<form>Search, please.</form>", "<div class='related'><article>More, here.</article></div>",
    "<div id='cookie-notice'>We use cookies, ok?</div>", "<div class='post-share'>Tell, all.</div>", "<div class='site__header'>Name, and claim.</div>",
])
def test_named_parts_stay_out(other):
    page = f"<html><head><title>T</title></head><body><article>{INNER}</article>{other}</body></html>"
    assert len(html_text.main_text(page).split("\n")) == 11


def test_an_advert_longer_than_the_article_stays_out():
    page = "<body><div class='ad'>Buy this, and that, and more of it, now.</div><article><h1>Title</h1><p>Short, so.</article></body>"
    assert html_text.main_text(page) == "Title\nShort, so."


def test_links_below_the_content_root_are_dropped():
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(6)) + "</ul>"
    mixed = "<ol><li>see <a href=/x>this</a> for the details</li></ol>"
    found = html_text.main_text(f"<body><article><h1>Title</h1>{PARAGRAPHS}{menu}{mixed}</article></body>").split("\n")
    assert found[11:] == ["see this for the details"]


MENU = "<div><ul><li>Home page</li><li>About us</li><li>Contact us</li></ul></div>"
COPYRIGHT = "<div>Copyright 2024 by us. All rights reserved.</div>"


@pytest.mark.parametrize("page", [f"<body>{MENU}<div>{INNER}</div>{COPYRIGHT}</body>", f"<body>{MENU}<article>{INNER}</article>{COPYRIGHT}</body>",
                                  f"<body>{MENU}{INNER}{COPYRIGHT}</body>"])
def test_menus_and_footers_without_a_name_go_by_the_threshold(page):
    assert len(html_text.main_text(page).split("\n")) == 11
    if "<article>" not in page:
        assert "Home page" in html_text.main_text(page, 0.0)  # without it they would stay


def test_words_inside_a_sentence_stay_whatever_their_name():
    page = f"<main>{INNER}<p>You must <span class='alert'>stop</span> now, <b class='ad'>please</b>.</p></main>"
    assert html_text.main_text(page).endswith("\nYou must stop now, please.")


@pytest.mark.parametrize("piece", ["<div>x", "<div>", "<blockquote>x", "<ul><li>a", "</p>x", "<form>x", "<section><p>y"])
def test_deep_pages_take_no_more_than_linear_time(piece):
    import time

    times = []
    for n in (2000, 16_000):
        start = time.process_time()
        html_text.main_text(piece * n)
        times.append(time.process_time() - start)
    assert times[1] < 30 * max(times[0], 0.02)


def plain_scores(blocks):
    """Scores from (path, text, characters in links, weight), with the formulas written out."""
    import math

    def mean(path, of):
        values = [of(b) for b in blocks if b[0] == path]
        return sum(values) / len(values)

    ratio = {p: (mean(p, lambda b: len(b[1])), mean(p, lambda b: len(re.findall(r"[^\w\s]", b[1]))) + 1 / sum(b[0] == p for b in blocks)) for p, *_ in blocks}
    out = {}
    for path in ratio:
        total = []
        for i, b in enumerate(blocks):
            if b[0] != path:
                continue
            near = [(ratio[blocks[j][0]], math.exp(-(i - j) ** 2 / 2)) for j in range(max(0, i - 2), min(len(blocks), i + 3))]
            weight = sum(w for _, w in near)
            smooth = [sum(r[k] * w for r, w in near) / weight for k in (0, 1)]
            total.append(math.sqrt(ratio[path][0] * smooth[0] * ratio[path][1] * smooth[1]))
        texts = [b for b in blocks if b[0] == path]
        links = 1 - sum(b[2] for b in texts) / sum(len(b[1]) for b in texts)
        out[path] = sum(total) / len(total) * links * texts[0][3]
    return out


def test_scores_equal_a_plain_version():
    import random

    rng = random.Random(5)
    for _ in range(20):
        parts, blocks = [], []
        for _ in range(rng.randrange(1, 25)):
            text = " ".join(rng.choice(["word,", "two", "a.", "longer-one", "x!"]) for _ in range(rng.randrange(1, 30)))
            around = rng.choice(["p", "div", "li", "form", "div class=ad", "section class=related"])
            tag = around.split()[0]
            linked = rng.random() < 0.3
            said = {"form": 0.2, "div class=ad": 0.005, "section class=related": 0.05}.get(around, 1.0)
            parts.append(f"<{around}>{'<a href=x>' + text + '</a>' if linked else text}</{tag}>")
            blocks.append(((tag, said), text, len(text) if linked else 0, said))
        page = html_text.Page("<body>" + "".join(parts) + "</body>")
        got = html_text.path_scores(page)
        mine = {(page.path_tags[p], html_text.WEIGHTS[page.path_said[p]]): s for p, s in got.items()}
        expected = plain_scores(blocks)
        assert mine.keys() == expected.keys()
        for path, score in expected.items():
            assert mine[path] == pytest.approx(score, rel=1e-9, abs=1e-12)


def test_pages_keep_their_keys(spark):
    frame = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    rows = html_text.extract_text(frame).orderBy("page_id").collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in rows] == [(1, "u", len(html_text.main_text(PAGE))), (2, None, 0), (2, None, 0)]


# --- shards ---

def test_shard_table_is_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    table = shards.fill_table(names, 2003)
    counts = Counter(table)
    assert len(table) == 2003 and max(counts.values()) - min(counts.values()) <= 1
    fewer = shards.fill_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.1 * 2003
    weighted = Counter(shards.fill_table(["a", "b"], 101, [3, 1]))
    assert weighted[0] in (75, 76)
    with pytest.raises(ValueError):
        shards.fill_table(names, 2000)


def test_shards_follow_the_table(spark):
    frame = spark.createDataFrame([(1,), (2,), (2,), (None,)], "slot long")
    rows = shards.assign_shards(frame, "slot", ["a", "b", "c"], 11, slot_column="place").collect()
    table = shards.fill_table(["a", "b", "c"], 11)
    for r in rows:
        place = shards.hash_of("" if r["slot"] is None else str(r["slot"])) % 11
        assert (r["place"], r["shard"]) == (place, "abc"[table[place]])


# --- line dedup ---

def plain_lines(texts, min_docs, first=False):
    keys = [[(k.strip(" \t\n\v\f\r").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))) for k in (t or "").split("\n")] for t in texts]
    docs = Counter(k for row in keys for k in set(row) if k)
    out, seen = [], set()
    for text, row in zip(texts, keys):
        kept = []
        for line, key in zip((text or "").split("\n"), row):
            if key and docs[key] >= min_docs and not (first and key not in seen):
                continue
            seen.add(key)
            kept.append(line)
        out.append((len(row), len(row) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("first", [False, True])
def test_lines_equal_a_plain_version(spark, first):
    import random

    random.seed(3)
    pool = ["Common Line", " common line\t", "", "É", "é", "x", *[f"line {i}" for i in range(30)]]
    texts = ["\n".join(random.choice(pool) for _ in range(random.randrange(1, 12))) for _ in range(200)] + [None, ""]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(7)
    rows = line_dedup.dedup_lines(frame, min_docs=9, keep_first=first).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in rows] == plain_lines(texts, 9, first)


def test_rows_are_documents(spark):
    """Ten equal rows of one line lose it, as in the query's SQL; nine do not."""
    for n, dropped in ((10, 1), (9, 0)):
        frame = spark.createDataFrame(rows_of(["same line\nown line"]) * 9 + rows_of(["Same Line "]) * (n - 9) + [(7, "other", "en", "s", 1, "n", "d", 1, 2, "k", "t")], SCHEMA)
        got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(frame).collect())
        assert got.count((0, 2, dropped, "own line" if dropped else "same line\nown line")) == 9 and (7, 1, 0, "other") in got and len(got) == n + 1


def test_runs_over_partition_edges():
    import random

    import pyarrow as pa

    names = ["h1", "h2", "doc", "text_hash", "copies", "pos"]
    for trial in range(60):
        random.seed(trial)
        copies = [random.choice([1, 1, 1, 3]) for _ in range(25)]  # of each document
        data = sorted({(random.choice([1, 1, 1, 2, 3, 4]), 0, d, 0, copies[d], random.randrange(3)) for d in (random.randrange(25) for _ in range(random.randrange(1, 120)))})
        for first in (False, True):
            by, expected = {}, set()
            for row in data:
                by.setdefault(row[0], []).append(row)
            for run in by.values():
                if sum(copies[d] for d in {x[2] for x in run}) >= 4:
                    expected |= set(run[1:] if first else run)
            cuts = [0]
            while cuts[-1] < len(data):
                at = cuts[-1] + random.randrange(1, 40)
                while at < len(data) and data[at][:4] == data[at - 1][:4]:
                    at += 1
                cuts.append(min(at, len(data)))
            got, left, sums = set(), [], {}
            for a, b in zip(cuts, cuts[1:]):
                runs, tables = line_dedup.Runs(4, first), []
                while a < b:
                    end = min(b, a + random.randrange(1, 15))
                    tables += runs.add(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*data[a:end]))}))
                    a = end
                tables += runs.finish()
                for row in (r for t in tables for r in t.to_pylist()):
                    line = tuple(row[n] for n in names)
                    if row["kind"] == 0:
                        got.add(line)
                    elif row["kind"] == 1:
                        left.append(line)
                    else:
                        sums.setdefault(line[0], []).append((row["n"], line))
            for line in left:
                found = sums[line[0]]
                if sum(n for n, _ in found) >= 4 and not (first and line == min(x for _, x in found)):
                    got.add(line)
            assert got == expected


# --- revisits ---

def test_revisits(spark):
    def rec(i, url, at, kind, **headers):
        return i, url, f"2024-01-{at}", kind, {k.replace("_", "-"): v for k, v in headers.items()}

    data = [
        rec(1, "http://www.A.org/p/", "01 10:00:00", "response", etag='"1"', server="x", date="d1"),
        rec(2, "https://a.org/p#top", "05 10:00:00", "response", etag='"2"', server="y"),
        rec(3, "https://a.org/p", "05 10:00:00", "response", etag='"3"', server="z"),
        rec(10, "https://a.org/p?utm_source=f", "01 11:00:00", "revisit", etag='W/"1"', server="q", date="d2"),
        rec(11, "https://a.org/p", "05 10:00:00", "revisit", etag='"1"'),
        rec(12, "https://a.org/p", "09 10:00:00", "revisit", etag='"3"', vary="v"),
        rec(13, "https://a.org/p", "09 10:00:00", "revisit"),
        rec(14, "https://a.org/p", "01 09:00:00", "revisit", etag='"1"'),
        rec(15, "https://a.org/p", "09 11:00:00", "revisit", etag='"9"'),
    ]
    frame = spark.createDataFrame(data, "record_id long, url string, fetched string, kind string, headers map<string,string>")
    frame = frame.withColumn("fetched", frame["fetched"].cast("timestamp_ntz"))
    frame = frame.unionByName(spark.createDataFrame([(20, None, None, "revisit", None)], frame.schema))
    got = {r["record_id"]: r for r in revisits.resolve_revisits(frame).collect()}
    assert {i: (r["response_id"], r["status"]) for i, r in got.items()} == {
        10: (1, "resolved"), 11: (1, "resolved"), 12: (3, "resolved"), 13: (3, "no_validator"), 14: (None, "no_response"),
        15: (3, "changed"), 20: (None, "no_response")}
    assert got[10]["headers"] == {"etag": 'W/"1"', "server": "x", "date": "d2"}
    assert got[12]["headers"] == {"etag": '"3"', "server": "z", "vary": "v"}
    assert got[15]["headers"] is None
    assert revisits.resolve_revisits(frame.limit(0)).count() == 0


def test_revisits_are_told_apart_by_row_not_by_id(spark, monkeypatch):
    schema = "record_id long, url string, fetched string, kind string, headers map<string,string>, row long, slice int, response_row long, copy long"
    extra = (1, 2, 3, 4)
    day = lambda n: f"2024-01-{n:02} 00:00:00"
    data = [
        (1, "https://a.org/x", day(1), "response", {"etag": '"x"'}, *extra), (1, "https://b.org/y", day(1), "response", {"etag": '"y"'}, *extra),
        (9, "https://a.org/x", day(2), "revisit", {"etag": '"x"'}, *extra), (9, "https://b.org/y", day(2), "revisit", {"etag": '"y"'}, *extra),
        (None, "https://a.org/x", day(3), "revisit", {"etag": '"x"'}, *extra), (None, "https://c.org/z", day(1), "response", {"etag": '"z"'}, *extra),
        (7, "https://c.org/z", day(2), "revisit", {"etag": '"z"'}, *extra), (7, "https://c.org/z", day(2), "revisit", {"etag": '"z"'}, *extra),
        (3, "https://d.org/", day(1), "response", {"etag": '"3"'}, *extra), (4, "https://d.org/", day(1), "response", {"etag": '"4"'}, *extra),
        (8, "https://d.org/", day(1), "revisit", {"etag": '"4"'}, *extra),
    ] + [(100 + i, "https://d.org/", day(5 + i % 20), "revisit", {"etag": '"4"'}, *extra) for i in range(60)]
    frame = spark.createDataFrame(data, schema).withColumn("fetched", F.col("fetched").cast("timestamp_ntz")).repartition(5)
    expected = [(9, "a.org/x", 1, "resolved")] + [(9, "b.org/y", 1, "resolved"), (None, "a.org/x", 1, "resolved")] + [(7, "c.org/z", None, "resolved")] * 2
    expected += [(8, "d.org", None, "no_response")] + [(100 + i, "d.org", 4, "resolved") for i in range(60)]
    for copies in (10_000, 7):  # a popular response is copied
        monkeypatch.setattr(revisits, "REVISITS_PER_COPY", copies)
        got = [(r["record_id"], r["url_key"], r["response_id"], r["status"]) for r in revisits.resolve_revisits(frame).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)


# --- embeddings, edge cases ---

def test_vectors_that_cannot_link(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (9, [1.0, 0.01], 1), (1, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [], 1)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    rows = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in cap_filters.near_embeddings(frame).collect())
    assert rows == [(0, 0, 0, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
                    (7, 0, 7, True), (8, 0, 8, True), (9, 3, 1, False), (10, 0, 10, True), (11, 0, 11, True)]
    assert cap_filters.near_embeddings(frame.limit(0)).count() == 0
