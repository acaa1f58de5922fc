import pytest

from tallyglass.llm.html_render import page_text, render

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("x <b>y</b>\n <i> z</i>", "x y z"),
    ("<script>var t='</p>';</script>seen<style>p{}</style><!-- not > this -->", "seen"),
    ("<title>t</title><noscript>n</noscript><template>q</template>v", "v"),
    ("<p hidden>a</p><p style='color:red; display: none'>b</p><p>c</p>", "c"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
    ("<details><summary>s</summary>body</details><details open><summary>t</summary>body</details>", "s\nt\nbody"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<ul><li><p>a</p><p>b</p></li></ul>", "- a\n\n  b"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><caption>cap</caption><tfoot><tr><td>f<td>g</tfoot><thead><tr><th>h<th>i</thead><tr><td>long<td>x</table>", "cap\nh     i\nlong  x\nf     g"),
    ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b  c"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<td>loose</td> text", "loose text"),
    ("<pre>a\n  b\n</pre>c", "a\n  b\n\nc"),
    ("<h1>h</h1>t<hr>u", "h\n\nt\n\nu"),
    ("1 < 2 and <3", "1 < 2 and <3"),
    ("a<p title='x>y'>b</p>", "a\n\nb"),
    ("end <a href='x", "end"),
    ("<select><option>a<option selected>b</select>", "b"),
    ("<input value='v'><input type=hidden value='w'><textarea>t\nu</textarea>", "v\nt\nu"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<p>a&nbsp;&lt;b&gt;</p>", "a\u00a0<b>"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_page(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize(
    "page",
    ["<div>" * 50_000 + "x", "<b>" * 20_000 + "</i>" * 20_000, '<a "' * 20_000, "<" * 50_000, "<li>" * 20_000 + "x", "<table><tr><td>" * 3_000 + "x", "<td colspan=1000>" * 2_000, "w " * 300_000, "</p>" * 20_000, "<ul>" * 5_000 + "<li>x"],
)
def test_odd_and_long_pages_take_linear_time(page):
    text = page_text(page)
    assert len(text) <= len(page) + 100_000


@pytest.mark.parametrize("around", ["<b>" * 200, "<a name=x>" * 5_000, "<div>" * 200, "<span><font>" * 20_000])
def test_depth_changes_nothing(around):
    for page, text in [
        ("<script>var s</script>a<style>p{}</style><textarea>t</textarea>", "a\nt"),
        ("<p hidden>x</p><div style='display:none'>y<i>z</i></div>a<i hidden>w</i>", "a"),
        ("<div style='visibility:hidden'>x<b style='visibility:visible'>b</b></div>", "b"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<ol><li>a<li>b<ul><li>c</ul></ol>", "1. a\n2. b\n   - c"),
        ("<pre>a\n  b</pre>", "a\n  b"),
    ]:
        assert page_text(around + page) == text
    # End tags of inner elements end those, not the ones around.
    assert page_text("<p hidden>" + around.replace("div", "u") + "<b>x</b><b>y</b>z</p>seen") == "seen"
    assert page_text("<section hidden>" + around + "<section>x</section>y</section>seen") == "seen"


@pytest.mark.parametrize("opening", ["<blockquote>", "<ul><li>", "<dl><dd>", "<table><tr><td>", "<i><table><tr><td><b>", "<select><option>", "<details open><summary>"])
def test_no_depth_loses_words_or_takes_long(opening):
    words = [f"w{i}" for i in range(2_000)]
    page = "".join(f"{opening}{w} " for w in words) + "</i>" * 5_000
    text = page_text(page)
    assert [w for w in text.split() if w != "-"] == words
    assert len(text) < 1_000 * len(words)


def test_no_word_of_a_visible_page_is_lost():
    words = [f"w{i}" for i in range(400)]
    tags = ["<p>", "<div>", "<li>", "<td>", "<tr>", "<h2>", "<ul>", "</ul>", "</div>", "<table>", "</table>", "<b>", "</p>", "<dd>", "<pre>", "</pre>", "</td>"]
    page = "".join(f"{tags[(i * 7 + i // 3) % len(tags)]} {w} " for i, w in enumerate(words))
    assert sorted(page_text(page).replace("-", " ").split()) == sorted(words)


def test_render_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, None, 5), (1, "<p>a", 6), (None, "<p>a", 7), (None, "<p>a", 7)], "page_id long, html string, text int")
    out = render(pages)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, ""), (1, "a"), (None, "a"), (None, "a")]
    assert render(pages.limit(0)).count() == 0
