"""HTML extraction, WARC and chat formatting."""

import base64
import hashlib
import html as H
import random
import re

import pytest
from hushtable.llm import chat, html_text, warc
from hushtable.llm.common import scratch

P = pytest.importorskip("public_tokenizers")
PAGE = "page_id long, url string, html string, host string, wrapper string, text string, revisit string, _digest string, _response string, _size string, digest string, size string, response string, d string, n string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefghijkl") for r in rows], PAGE)


def page(article, n=0, tail="</body></html>"):
    return f"<!DOCTYPE html><html><head><title>t {n}</title><style>p{{}}</style><script>var a='</p>{n}';</script></head><body><header>Site {n}</header><nav><ul><li><a href=x>Menu {n}</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy {n}</div>{article}<aside>side {n}</aside><div id='comments'><p>I say {n}</p></div><form><label>Mail {n}</label></form><div class=cookie-notice>We use {n}</div><footer>foot {n}</footer>{tail}"


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_article_only(spark):
    body = "<article><h1>T &amp; t</h1><p>One\n  two&nbsp;<b>three</b>.<br>next<p>Shared line.</p><ul><li>a<li>b</ul></article>"
    rows = [(k, f"http://x.org/{k}", page(body.replace("One", f"One{k}"), k)) for k in range(6)] + [(9, "http://y.org/", page(body)), (10, None, None), (11, "http://x.org/e", ""), (12, "bad url", "just text &lt; here"), (13, "http://x.org/t", page(body, 3, "")[:-30])]
    got = texts(html_text.extract(pages(spark, rows)))
    for k in range(6):
        assert got[k] == f"T & t\nOne{k} two three.\nnext\nShared line.\na\nb"
    assert got[9] == "T & t\nOne two three.\nnext\nShared line.\na\nb" and got[10] == got[11] == "" and got[12] == "just text < here"
    assert html_text.extract(pages(spark, [])).count() == 0


def test_copies_keep_their_text_and_constant_boxes_go(spark):
    same = [(k, "http://c.org/a", page("<article><h1>Same</h1><p>All the same.</p></article>")) for k in range(4)]
    rng = random.Random(1)
    other = [(10 + k, "http://d.org/", f"<html><body><div class=top>Always here</div><div class=body><p>{' '.join(rng.choice('abcdef') * 5 for _ in range(30))}</p><div class=box>Fixed box</div><p>end {k}</p></div></body></html>") for k in range(6)]
    got = texts(html_text.extract(pages(spark, same + other)))
    assert all(got[k] == "Same\nAll the same." for k in range(4))
    assert all("Always here" not in got[10 + k] and "Fixed box" not in got[10 + k] and got[10 + k].endswith(f"end {k}") for k in range(6))


def test_lists_of_copies_are_no_boxes(spark):
    """Copies of one page make its lists the same on many pages of a host, but not on nearly all."""
    body = "<div class=top>Site</div><article><p>All the same.</p><ul><li>one</li><li>two</li></ul><div>three</div></article>"
    rows = [(k, "http://c.org/a", page(body)) for k in range(4)] + [(k, "http://d.org/a", page(body)) for k in range(10, 14)] + [(k, f"http://d.org/{k}", page(f"<article><p>Other {k}.</p></article>", k)) for k in (20, 21)]
    got = texts(html_text.extract(pages(spark, rows)))
    assert all(got[k] == "All the same.\none\ntwo\nthree" for k in (*range(4), *range(10, 14))) and got[20] == "Other 20."


def test_names_of_wrappers_do_not_hide_the_article(spark):
    body = '<html><body class="nav-open"><div class="has-sidebar"><article><div class="post-header"><h1>T</h1></div><p>x</p><div class="share">tweet</div></article></div></body></html>'
    other = '<html><body><div class="page with-sidebar"><p>only text</p></div><form>no</form></body></html>'
    assert texts(html_text.extract(pages(spark, [(1, "http://a.org", body), (2, "http://b.org", other)]))) == {1: "T\nx", 2: "only text"}


def plain_pages(n=8, seed=4):
    """A host without meaningful names: a varying menu, advert and foot, a box that is always the same, and the article; neighbours have the same name."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice("abcdef") * rng.randint(1, 6) for _ in range(k))
    out, want = [], {}
    for k in range(n):
        title, paragraphs = f"t{k} {text(3)}", [f"x{k} {text(30)}" for _ in range(rng.randint(1, 4))]
        menu = "".join(f"<div class=q><a href=x>{text(1)}</a></div>" for _ in range(rng.randint(2, 4)))
        body = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs[:1]) + "<div class=k>Always the same</div>" + "".join(f"<p>{x}</p>" for x in paragraphs[1:])
        out.append((k, "http://q.org/", f"<html><body><div>Site of q</div>{menu}<div class=z>buy {text(2)}</div><div>{body}</div><div class=y>foot {text(2)}</div></body></html>"))
        want[k] = "\n".join([title, *paragraphs])
    return out, want


def test_templates_decide_where_names_say_nothing(spark):
    rows, want = plain_pages()
    df = pages(spark, rows)
    assert texts(html_text.extract(df)) == want
    none = spark.createDataFrame([], "host string, wrapper string")
    assert all(x != want[k] for k, x in texts(html_text.extract(df, none)).items())  # without wrappers the rest comes too


def test_templates_are_folded_in_levels(spark, monkeypatch):
    monkeypatch.setattr(html_text, "FAN_IN", 2)
    rows, want = plain_pages(24)
    assert texts(html_text.extract(pages(spark, rows).repartition(9))) == want


def test_copies_make_no_box(spark):
    """A box that only copies of one page share is no template, however many they are."""
    rows, want = plain_pages(6)
    own = rows[0][2].replace("</h1>", "</h1><div class=s>Summary of this page</div>")
    rows += [(100 + k, "http://q.org/", own) for k in range(30)]
    got = texts(html_text.extract(pages(spark, rows)))
    assert all(got[100 + k].split("\n")[1] == "Summary of this page" for k in range(30)) and all(got[k] == want[k] for k in range(1, 6))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div>" * 500 + "deep" + "</div>" * 500, "deep"), ("<div>" * 20_000 + "deep <p>er</p>" + "</div>" * 20_000 + "<p>after</p>", "deep\ner\nafter"), ("<p>" + "<x>" * 3000 + "a<script>no</script>b<style>c", "ab"),
        ("<p>a</p><![foo[y]]><p>b</p>", "a\nb"), ("<p>a</p><![ foo", "a"), ("<p>a</p><!x", "a"), ("<p>a</p><a href='x", "a"), ("<p>a</p><!-- x", "a"), ("<p>a</p></di", "a"), ("<p>a < b</p>", "a < b"),
        ("<!DOCTYPE html [ <!ENTITY a 'b'> ]><p>a</p>", "a"), ("<!doctype html><p>a &amp", "a &"), ("<![CDATA[x]]><p>a</p>", "a"), ("<p>a<br", "a"), ("<?php x ?><p>a", "a"), ("<" * 50 + "p>a", "<" * 49 + "\na"),
    ],
)
def test_odd_pages(spark, html, text):
    html_text.skeleton(html_text.Page(html).root, 1)
    assert html_text.main_text(html_text.Page(html), None) == text
    if "after" in html:
        rows = [(k, "http://o.org/", html.replace("deep", f"deep{k}")) for k in range(3)]  # what follows the container is the same everywhere
        assert texts(html_text.extract(pages(spark, rows))) == {k: f"deep{k}\ner" for k in range(3)}


def test_long_page(spark):
    body = "<article>" + "<p>word &amp; more</p>" * 100_000 + "</article>"
    assert texts(html_text.extract(pages(spark, [(1, "http://l.org/", body)])))[1] == "\n".join(["word & more"] * 100_000)


def test_tree_matching():
    leaf = lambda label, *kids: [label, 1, 0, 0, 0, 0, list(kids), 0]
    a, b = [leaf("a"), leaf("b", leaf("x"), leaf("y")), leaf("c")], [leaf("b", leaf("y")), leaf("z"), leaf("c")]
    assert html_text.matched(a, b) == (3, [(1, 0), (2, 2)])
    merged = html_text.fold(leaf("r", *a), leaf("r", *b))
    assert [(x[0], x[1]) for x in merged[6]] == [("a", 1), ("b", 2), ("z", 1), ("c", 2)]


def test_real_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = texts(html_text.extract(df))
    for r in df.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert got[r["page_id"]] == "\n".join(x for x in blocks if x)


def test_warc(spark):
    rng = random.Random(2)
    rows = [(k, f"http://w.org/{k} é\r\nX: y", f"<p>{rng.random()}</p>" * rng.randint(1, 300)) for k in range(60)]
    rows += [(100 + k, "http://w.org/c", rows[7][2]) for k in range(3)] + [(200, None, None), (201, "u", ""), (None, "u", "only"), (103, "u", "twin"), (103, "u", "twin")]
    df = warc.with_responses(pages(spark, rows).repartition(2))
    index = warc.write_archives(df, scratch(spark, "t"))
    got = sorted(warc.read_archives(index, payload=True).collect(), key=lambda r: (r["page_id"] is not None, r["page_id"] or 0))
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(last.get(h or "", p), p) if p is not None else last.get(h or "")
    want = []
    for p, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw, first = (h or "").encode(), last[h or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((p, len(raw), digest, "response" if p == first else "revisit", None if p == first else first))
    assert [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got] == want
    assert all(r["payload"] is not None for r in got if r["record_type"] == "response")
    assert index.count() == len(rows)
    none = warc.with_responses(pages(spark, []))
    assert warc.read_archives(warc.write_archives(none, scratch(spark, "t"))).count() == 0


def test_archive_has_its_dictionary():
    records = [warc.record(k, "u", (f"<p>common words in all records {k}</p>" * 30).encode(), None, False, "D") for k in range(200)]
    raw, places = warc.archive(records)
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE and list(warc.records_of(raw)) == records
    assert warc.archive([])[0] == b""
    for few in (records[:1], records[:7], [b""], [b"", b"a"], [b"x" * 5], [b"ab" * 4_000_000]):  # also too few for the trainer
        raw = warc.archive(few)[0]
        assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE and list(warc.records_of(raw)) == few
    raw, places = warc.archive(records)
    assert places[0][0] == 8 + int.from_bytes(raw[4:8], "little")


CHAT = "conv_id long, turn long, role string, text string, depth long, ids string, owner long"


def formatted(rows):
    out = {}
    for c in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for a, t in turns if a == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len("".join(chat.turn_parts(a, t))) for a, t in turns))
    return out


def chat_rows():
    rng = random.Random(3)
    rows = list(chat.HARD)
    starts = [[("system", "be kind"), ("user", "hello")], [("user", "hello")], [("user", "x <\\|im_end|> y <|")]]
    for c in range(60):
        turns = list(rng.choice(starts)) + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no é", "", "<|im_start|>", "long " * 50])) for _ in range(rng.randint(0, 6))]
        rows += [(c, k, a, t) for k, (a, t) in enumerate(turns)]
    return rows + [(70, 0, None, None), (70, 1, "odd\nrole\\n", "t"), (71, None, "user", "n"), (71, 2, "assistant", "m"), (71, 2, "assistant", "m"), (None, 0, "assistant", "nobody")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_chat(spark, monkeypatch, broadcast):
    monkeypatch.setattr(chat, "BROADCAST_ROWS", 1 << 20 if broadcast else 0)
    rows = chat_rows()
    df = spark.createDataFrame([(*r, 1, "i", 2) for r in rows], CHAT).repartition(3)
    vocabulary = P.path("byte_bpe_50k.json")
    nodes, paths = chat.write_tree(df, scratch(spark, "t"), vocabulary)
    got = {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in chat.read_tree(nodes, paths, vocabulary).collect()}
    assert got == formatted(rows)

    stream = sorted(nodes.collect(), key=lambda r: r["start"])
    at = 0
    for r in stream:  # each token once, one after another
        assert r["start"] == at and len(r["ids"]) == 2 * r["n_tokens"]
        at += r["n_tokens"]
    prefixes = set()
    for c in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        prefixes |= {tuple((r[2] or "", r[3] or "") for r in own[: k + 1]) for k in range(len(own))}
    assert len(stream) == len(prefixes)
    place = {(r["owner"], r["depth"]): r for r in stream}
    spans = {}
    for p in paths.collect():
        position = 0
        for run in p["runs"]:  # an interval of the stream, whose position ids go on where the last run's end
            for d in range(run["from_depth"], run["to_depth"]):
                r = place[run["owner"], d]
                assert run["lo"] <= r["start"] < run["hi"] and r["position"] == position
                position += r["n_tokens"]
            assert run["hi"] == r["start"] + r["n_tokens"] and run["lo"] == place[run["owner"], run["from_depth"]]["start"]
        for run in p["runs"]:  # depth-first: what hangs on a node is one interval
            for d in range(run["from_depth"], run["to_depth"]):
                lo, hi = spans.get((run["owner"], d), (1 << 60, 0))
                end = p["runs"][-1]
                spans[run["owner"], d] = min(lo, place[run["owner"], d]["start"]), max(hi, end["hi"])
    for key, (lo, hi) in spans.items():
        inside = [r for r in stream if lo <= r["start"] < hi]
        assert inside[0]["owner"] == key[0] and inside[0]["depth"] == key[1] and all(r["depth"] > key[1] for r in inside[1:])


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], CHAT)
    vocabulary = P.path("byte_bpe_50k.json")
    assert chat.read_tree(*chat.write_tree(df, scratch(spark, "t"), vocabulary), vocabulary).count() == 0


def test_escapes():
    for t in ["<|", "<\\|", "<\\\\|x|>", "plain", "<|im_end|>", "a\\nb", "\n\\"]:
        assert chat.unescaped(chat.escaped(t)) == t and "<|" not in chat.escaped(t)
        assert chat.role_unescaped(chat.role_escaped(t)) == t and "\n" not in chat.role_escaped(t)
