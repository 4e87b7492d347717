import itertools
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from arcweft.llm import bpe, html, langid, queries_text, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- BPE ---


@pytest.fixture(scope="module")
def ours():
    return bpe.Tokenizer(open(PATH, encoding="utf-8").read())


def naive(t, piece):
    """Leftmost pair of the lowest rank, again and again."""
    part = [t.first[b] for b in piece]
    while True:
        found = min(((t.merges[p][0], i) for i, p in enumerate(zip(part, part[1:], strict=False)) if p in t.merges), default=None)
        if not found:
            return part
        i = found[1]
        part[i : i + 2] = [t.merges[part[i], part[i + 1]][1]]


def test_merges_are_those_of_a_plain_search(ours):
    r = random.Random(1)
    for _ in range(500):
        piece = bytes(r.choice(b"aabbtheing \xc3\xa9\xff") for _ in range(r.randint(1, 30)))
        assert ours.encode_piece(piece) == naive(ours, piece)
    long = b"ab" * 3000
    assert ours.encode_piece(long) == ours.encode_piece(b"ab" * 3000) and b"".join(ours.bytes[i] for i in ours.encode_piece(long)) == long


def test_encoding_is_the_librarys(ours):
    library = Library.from_file(PATH)
    r = random.Random(2)
    pool = [chr(c) for c in [*range(0, 0x200), 0x1680, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301, 0xFEFF, 0x2160]] + ["<|endoftext|>", "<|endof", "'s", "'LL", "  ", "\n\n", "the"]
    for text in ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 20000, *("".join(r.choice(pool) for _ in range(r.randint(1, 20))) for _ in range(3000))]:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = ours.encode(text)
        assert packed == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        assert ours.decode(packed) == library.decode(ids, skip_special_tokens=False) == text


def test_codec_columns(spark):
    texts = ["", None, "Hello  world", "a<|endoftext|>b", "é" * 5000] * 3
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    codec = bpe.Codec(spark, PATH)
    library = Library.from_file(PATH)
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    both = codec.round_trip(df).withColumn("a", bpe.as_array(F.col("ids"))).orderBy("doc_id").collect()
    assert [r.a for r in both] == expected and [r.decoded for r in both] == [t or "" for t in texts]
    apart = codec.decode(codec.encode(df, name="packed"), "packed", "back").orderBy("doc_id").collect()
    assert [bytes(r.packed) for r in apart] == [bytes(r.ids) for r in both] and [r.back for r in apart] == [t or "" for t in texts]
    assert codec.round_trip(df.limit(0)).count() == 0


def test_pieces_are_kept_up_to_a_bound(ours, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    pieces = bpe._Pieces(ours)
    for k in range(500):
        assert pieces[f" w{k % 120}"] == struct.pack(f"<{len(x)}I", *x) if (x := naive(ours, f" w{k % 120}".encode())) else True
        assert len(pieces) <= 50 and len(pieces.old) <= 50


# --- language ID ---

SYLLABLES = {"aa": "ka to mi re sun bel".split(), "bb": "schi grü ver ung lich zen".split(), "cc": "eau tré qui vous ment lle".split()}


def write(lang, r, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def language_model(spark):
    r = random.Random(5)
    rows = [(i, write(lang, r, r.randint(3, 60)), lang) for i, lang in enumerate(list(SYLLABLES) * 80)]
    return langid.train(spark.createDataFrame([*rows, (None, "x", None), (900, None, "aa")], "doc_id long, text string, lang string"), per_language=60)


def test_languages_are_told_apart_and_others_rejected(spark, language_model):
    r = random.Random(6)
    rows = [(write(lang, r, 12), lang) for lang in list(SYLLABLES) * 30]
    df = spark.createDataFrame([(t, lang, "mine") for t, lang in rows], "text string, lang string, score string")
    got = langid.identify(df, language_model).collect()
    assert np.mean([x.language.lang_pred == x.lang for x in got]) > 0.97 and not any(x.language.rejected for x in got)
    assert all(x.score == "mine" and 0.5 < x.language.score <= 1 for x in got)
    odd = spark.createDataFrame([("xqzj wxkq qqzx jjxw kkqz " * 5,), ("",), (None,), ("123 ++ ² ½",), ("\n\t",)], "text string")
    rows = [x.language for x in langid.identify(odd, language_model).collect()]
    assert rows[0].rejected and rows[0].score < 0.5 and rows[0].lang_pred in SYLLABLES
    assert all(x.lang_pred == "und" and x.rejected and x.score == 0 for x in rows[1:])


def test_probabilities_of_each_context_sum_to_one(language_model):
    letters = sorted({c for s in SYLLABLES.values() for x in s for c in x} | {" "})
    for context in (" ka", " sch", "eau", "kato", "zzz", " "):
        total = sum(np.exp(_conditional(language_model, context + c)) for c in letters if c != " " or context != " ")
        assert (total < 1.001).all() and (total > 0.9).all(), (context, total)


def _conditional(m, gram):
    """Log probability of the last character of a gram, by looking the model up the plain way."""

    def row(g, what):
        codes = np.frombuffer(g.encode("utf-32-le"), np.uint32)
        h = langid._hashes(codes, len(g))[-1][-1]
        t = m.hashes[len(g) - 1]
        k = int(np.searchsorted(t, h))
        return what[len(g) - 1][k] if k < len(t) and t[k] == h else None

    value = m.floor
    for n in range(1, len(gram) + 1):
        g = gram[-n:]
        found = row(g, m.logp)
        if found is not None:
            value = found
        elif n > 1 and (w := row(g[:-1], m.weight)) is not None:
            value = value + w
    return value


def test_scores_are_those_of_plain_lookups(language_model):
    words = ["kato", "zzz", "schgrü", "e", "quivous" * 5]
    got = language_model.score_words(words)
    for w, row in zip(words, got, strict=True):
        text = f" {w} "
        expected = sum(_conditional(language_model, text[max(0, i - langid.ORDER + 1) : i + 1]) for i in range(1, len(text)))
        assert np.allclose(row[:-1], expected) and row[-1] == len(w) + 1


FOREIGN = ["Съешь ещё этих мягких французских булок да выпей чаю сегодня вечером", "Ξεσκεπάζω την ψυχοφθόρα σου βδελυγμία και περπατώ στον δρόμο"]


@pytest.mark.parametrize("rare", [10, 2, 1])
def test_rare_language_rejects_foreign_scripts(spark, rare):
    r = random.Random(8)
    langs = ["aa"] * 80 + ["bb"] * 80 + ["cc"] * rare
    model = langid.train(spark.createDataFrame([(i, write(lang, r, r.randint(10, 40)), lang) for i, lang in enumerate(langs)], "doc_id long, text string, lang string"))
    assert np.isfinite(model.bound).all() and (model.usual > 0).all()
    texts = [*FOREIGN, *(write("cc", r, 30) for _ in range(20))]
    got = [x.language for x in langid.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()]
    assert all(x.rejected for x in got[:2])
    if rare == 10:
        assert sum(x.lang_pred == "cc" and not x.rejected for x in got[2:]) >= 18


def test_only_rare_languages(spark):
    r = random.Random(9)
    for langs in (["aa"] * 10 + ["bb"] * 10, ["aa"]):
        model = langid.train(spark.createDataFrame([(i, write(lang, r, 30), lang) for i, lang in enumerate(langs)], "doc_id long, text string, lang string"))
        assert all(x.language.rejected for x in langid.identify(spark.createDataFrame([(t,) for t in FOREIGN], "text string"), model).collect())


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert [x.language.lang_pred for x in langid.identify(docs, model).collect()] == ["und"]
    assert langid.identify(docs.limit(0), model).count() == 0


# --- toxicity ---


def test_marginals_by_enumeration():
    r = np.random.default_rng(1)
    moves = r.normal(size=(2, 2))
    lengths = np.array([4, 1, 6, 3])
    speak = r.normal(size=lengths.sum())
    got, expected_pairs = toxicity.marginals(speak, lengths, moves, pairs=True)
    at, pairs, want = 0, np.zeros((2, 2)), []
    for n in lengths:
        x = speak[at : at + n]
        at += n
        weights = {s: np.exp(sum(x[i] * s[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(s, s[1:], strict=False))) for s in itertools.product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        want += [sum(w for s, w in weights.items() if s[i]) / z for i in range(n)]
        for s, w in weights.items():
            for a, b in zip(s, s[1:], strict=False):
                pairs[a, b] += w / z
    assert np.allclose(got, want) and np.allclose(expected_pairs, pairs)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_marginals_of_long_chains_do_not_depend_on_pieces(monkeypatch, piece):
    r = np.random.default_rng(4)
    for scale in (0.3, 2.0, 8.0):
        moves, lengths = scale * r.normal(size=(2, 2)), np.array([1, 50, 2, 130, 3, 7, 64, 65])
        speak = scale * r.normal(size=lengths.sum())
        monkeypatch.setattr(toxicity, "PIECE", 1000)
        want, want_pairs = toxicity.marginals(speak, lengths, moves, pairs=True)
        monkeypatch.setattr(toxicity, "PIECE", piece)
        got, got_pairs = toxicity.marginals(speak, lengths, moves, pairs=True)
        assert np.allclose(got, want) and np.allclose(got_pairs, want_pairs)
    starts, sizes, nth = toxicity.pieces(np.array([piece * 2 + 1, 1]))
    assert sizes.tolist() == [piece, piece, 1, 1] and nth.tolist() == [0, 1, 2, 0] and starts[-1] == piece * 2 + 1


def test_sample_counts_an_id_once_and_ends_at_its_characters(spark):
    rows = toxic_rows(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7, None)] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    once, often = toxicity.train(docs, labels), toxicity.train(docs.union(docs).union(docs), labels.union(labels))
    assert once.weights == often.weights and once.scale == often.scale
    few = toxicity.train(docs, labels, chars=3000)
    assert few.weights != once.weights
    assert toxicity.train(docs, labels, chars=-1).fallback == 0.0


def toxic_rows(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("bcdfglmnr") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(300)]
    bad = ["scoundrel", "wretchings", "wretchest", "vilent"]
    rows = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        y = int(r.random() < 0.2)
        for _ in range(r.randint(1, 3) * y):
            text.insert(r.randint(0, len(text)), r.choice(bad))
        rows.append((i, " ".join(text), y))
    return rows


def test_toxic_documents_and_spans(spark):
    rows = toxic_rows(600, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:400]] + [(5000, 1), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    extra = docs.withColumn("score", F.lit("mine"))
    got = {r.doc_id: r for r in toxicity.score(extra, model).collect()}
    right = [(got[i].toxicity.score >= 0.5) == bool(y) for i, _, y in rows[400:]]
    assert np.mean(right) > 0.97 and all(r.score == "mine" for r in got.values())
    i, text, _ = next(x for x in rows[400:] if x[2])
    spans = [text[s.start : s.stop] for s in got[i].toxicity.spans]
    assert spans and all(any(b in s for b in ("scoundrel", "wretch", "vilent")) for s in spans)
    odd = toxicity.score(spark.createDataFrame([("",), (None,), ("12 !",), ("İ SCOUNDREL x",)], "text string"), model).collect()
    assert len({r.toxicity.score for r in odd[:3]}) == 1 and odd[0].toxicity.score < 0.5 and [len(r.toxicity.spans) for r in odd] == [0, 0, 0, 1]
    assert "İ SCOUNDREL x"[odd[3].toxicity.spans[0].start : odd[3].toxicity.spans[0].stop] == "SCOUNDREL"
    for text in ("İstanbul SCOUNDREL here", "İİ İstanbulİ\nİ scoundrel", "ǅ ß İ " * 300 + "Scoundrel"):
        (span,) = toxicity.score(spark.createDataFrame([(text,)], "text string"), model).first().toxicity.spans
        assert text[span.start : span.stop].lower() == "scoundrel"
    again = {r.doc_id: r.toxicity.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert again == {i: r.toxicity.score for i, r in got.items()}


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).first().toxicity.score == 0
    assert toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).first().toxicity.score == 1


# --- HTML ---


def test_tree_marginals_by_enumeration():
    r = np.random.default_rng(2)
    trees = [html.parse(p) for p in ("<div><p>a<b>c</b></p>d</div>", "<p>x", "")]
    forest, n = html.Forest(trees), [len(t.tag) for t in trees]
    own, ties = r.normal(size=sum(n)), r.normal(size=(2, 2, 2))
    got, pairs = forest.marginals(own, ties)
    want, expected, at = [], np.zeros((2, 2, 2)), 0
    for t, size in zip(trees, n, strict=True):
        weights = {}
        for s in itertools.product((0, 1), repeat=size):
            weights[s] = np.exp(sum(own[at + i] * s[i] for i in range(size)) + sum(ties[int(not t.tag[i]), s[t.parent[i]], s[i]] for i in range(1, size)))
        z = sum(weights.values())
        want += [sum(w for s, w in weights.items() if s[i]) / z for i in range(size)]
        for s, w in weights.items():
            for i in range(1, size):
                expected[int(not t.tag[i]), s[t.parent[i]], s[i]] += w / z
        at += size
    assert np.allclose(got, want) and np.allclose(pairs, expected)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- <p>gone</p> -->
<div class="ad">Buy this now, today.</div><article><h1>Head&nbsp;line &lt;1&gt;</h1><p><b>First  part.<br><p>Second
 part &eacute; goes on, and on.</p><p>Third<script>x()</script> one here.</p></article><aside class="sidebar"><p>See also this, and that.</p></aside>
<section class="comments"><div class="comment"><p>I liked this article, a lot. Thanks.</p></div></section><form><label>Name</label><input></form><footer>&copy; us</footer>"""


def test_main_text(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "plain text only"), (5, "<p" * 50 + "<div>" * 5000), (6, "<!-- open <article>x</article>"), (7, "<article><p>" + "long text, here. " * 20000 + "</p></article>")]
    df = spark.createDataFrame([(i, h, "mine") for i, h in rows], "page_id int, html string, url string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got[1] == "Head line <1>\nFirst part.\nSecond part é goes on, and on.\nThird one here."
    assert got[2] == got[3] == got[6] == "" and got[7] == ("long text, here. " * 20000).strip()
    assert html.extract(df.limit(0)).count() == 0


def test_held_out_pages():
    pages = html.labelled_pages(120, seed=99)
    assert pages != html.labelled_pages(120, seed=98)
    model = html.default_model()
    got = html.main_texts([re.sub(' data-label="."', "", p) for p in pages], model)
    missing = extra = total = 0
    for page, text in zip(pages, got, strict=True):
        tree = html.parse(page)
        for i in range(len(tree.label)):
            tree.label[i] = tree.label[i] if tree.label[i] >= 0 else tree.label[tree.parent[i]] if i else 0
        want = Counter(html._joined(tree, np.array(tree.label) == 1).split("\n"))
        have = Counter(text.split("\n"))
        missing += (want - have).total()
        extra += (have - want).total()
        total += want.total()
    assert missing < 0.04 * total and extra < 0.04 * total


def test_forgiving_parse():
    tags = lambda page: [(t.tag[i], t.tag[t.parent[i]]) for t in [html.parse(page)] for i in range(1, len(t.tag)) if t.tag[i]][1:]
    assert tags("<ul><li>a<li>b</ul><p>x<p>y</i>") == [("ul", "body"), ("li", "ul"), ("li", "ul"), ("p", "body"), ("p", "body")]
    assert tags("<table><tr><td>1<td>2<tr><td>3</table>z") == [("table", "body"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr")]
    assert tags("a < b <br/> <IMG src='>'>") == [("br", "body"), ("img", "body")]
    assert tags("<html><head><title>x</title><meta><p>a</html>b<body class=x><p>c") == [("head", "html"), ("title", "head"), ("meta", "head"), ("body", "html"), ("p", "body"), ("p", "body")]
    assert tags("<select><option>a<optgroup><option>b<p>c<button>d<p>e") == [("select", "body"), ("option", "select"), ("optgroup", "select"), ("option", "optgroup"), ("p", "body"), ("button", "p"), ("p", "body")]
    assert tags("<p><span><div>x</div><li><span><li>") == [("p", "body"), ("span", "p"), ("div", "body"), ("li", "body"), ("span", "li"), ("li", "body")]
    assert tags("<a title=it's>x</a><p don't>") == [("a", "body"), ("p", "body")] and html.parse("<").text[-1] == "<"


PROSE = "Some prose that goes on, for a while, with words. And a second sentence, too."
PARAGRAPH = f"<p>{PROSE}</p>"
WHOLE = {  # pages that are content but for what is named
    "<html><head><title>x</title></head><body><h1>Head line here</h1>" + 3 * PARAGRAPH: ["Head line here", *3 * [PROSE]],
    "<html><head><title>x</title></head><body><h1>Head line here</h1>" + 10 * PARAGRAPH + "</body></html>": ["Head line here", *10 * [PROSE]],
    "<body><p>Some prose here, in one paragraph. It is short.</p>": ["Some prose here, in one paragraph. It is short."], "<body><p>prose</p>": ["prose"],
    "just some plain text, no markup at all. Really none.": ["just some plain text, no markup at all. Really none."],
    '<html><body><div id="root"><h1>Head</h1>' + 5 * PARAGRAPH + "</div></body></html>": ["Head", *5 * [PROSE]],
    "<title>x</title><meta charset=u><article><h1>Head</h1>" + 3 * PARAGRAPH + "</article>": ["Head", *3 * [PROSE]],
    "<html><head><title>x</title><main><h1>Head</h1>" + 3 * PARAGRAPH: ["Head", *3 * [PROSE]],
    "<article><h1>Head</h1><button>Share" + 3 * PARAGRAPH + "</article>": ["Head", *3 * [PROSE]],
    "<article><h1>Head</h1><select><option>a<option>b" + 3 * PARAGRAPH + "</article>": ["Head", *3 * [PROSE]],
    "<article><h1>Head</h1><svg><path d='M0'>" + 3 * PARAGRAPH + "</article>": ["Head", *3 * [PROSE]],
    f'<article><p>See <a href="/x>link</a> and more of it, here.</p>{PARAGRAPH}</article>': ["See link and more of it, here.", PROSE],
    f"<article><h1>T</h1><p>The formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, as is known.</p>{PARAGRAPH}<xmp>a <b> c</xmp></article>": ["T", "The formula x=2 holds, as is known.", PROSE, "a <b> c"],
    "<body><nav><a href=/>Home</a> <a href=/x>More</a></nav><h1>Head line</h1>" + 4 * PARAGRAPH + "<footer>&copy; us</footer>": ["Head line", *4 * [PROSE]],
}


def test_query_keeps_whole_pages(spark, tmp_path):
    rows = [(i, f"u{i}", page) for i, page in enumerate(WHOLE)] + [(100, None, None), (None, "u", ""), (1, "u1", list(WHOLE)[1])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries_text.op1_html_text(spark, str(tmp_path)).collect()
    want = [(i, u, "\n".join(WHOLE.get(page, [])), len("\n".join(WHOLE.get(page, [])))) for i, u, page in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("part", ["<span>|<li>", "</x>|<b>|</i>", '<a href="', "<p class='x", "<!", "<div><p>", "<table><tr><td>", "<dl><dt><span>", "<select><option>", "<script>", "<a x |=>", "<!--"])
def test_time_is_linear_in_a_page(part):
    def seconds(size):
        page = "".join(x * (size // len(part)) for x in part.split("|"))
        began = time.process_time()
        html.main_texts([page], html.default_model())
        return time.process_time() - began

    html.default_model()
    small, large = seconds(100_000), seconds(800_000)
    assert large < 20 * max(small, 0.05)


def test_deep_trees_have_the_same_marginals(monkeypatch):
    pages = [re.sub(' data-label="."', "", p) for p in html.labelled_pages(30, seed=5)]
    want = html.main_texts(pages, html.default_model())
    monkeypatch.setattr(html, "LEVELS", 0)
    assert html.main_texts(pages, html.default_model()) == want and any(want)
