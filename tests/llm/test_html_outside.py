"""Lines outside of a marked article are judged by differencing: the host's go, the page's own stay."""

from reelgrid.llm import html_text


def test_lines_outside_of_an_article(spark):
    page = lambda k: f"<p>Site line</p><h2>Our site</h2><article><p>shared licence</p><p>text {k}</p></article><p>own note {k}</p>"
    df = spark.createDataFrame([(k, f"http://h.com/{k}", page(k)) for k in range(3)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()} == {k: f"shared licence text {k} own note {k}" for k in range(3)}


def texts(spark, bodies, host="h.com"):
    rows = [(k, f"http://{host}/{k}", b) for k, b in enumerate(bodies)]
    return [r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_a_name_alone_deletes_nothing(spark):
    said = "<p>The council voted on Monday to keep the library open all year.</p>"
    whole = "The council voted on Monday to keep the library open all year."
    for body in (f"<div class='social-policy'>{said}</div>", f"<div id='notice-of-meeting'>{said}</div>", f"<main><div class='related-work'>{said}</div></main>", f"<div class='comments'>{said}</div>", f"<main><p>Head words here.</p><div class='related-work'>{said}</div></main>"):
        assert texts(spark, [body])[0].endswith(whole), body


def test_containers_that_come_again_go(spark):
    body = lambda k, name: f"<div><p>Own words of page {k} stand here for all to read.</p></div><div class='{name}'><p>Quite another thing was said by reader {k} of this page today.</p></div>"
    own = [f"Own words of page {k} stand here for all to read." for k in range(3)]
    assert texts(spark, [body(k, "reply-list") for k in range(3)]) == own
    assert texts(spark, [body(k, f"reply-{k}") for k in range(3)]) == own  # numbers aside
    one = texts(spark, [body(0, "reply-list"), body(1, "body"), body(2, "body")])
    assert "reader 0" in one[0] and "reader 1" in one[1]  # a neighbour has no such container
    # in a marked article, a part of a word does not go by coming again
    work = lambda k: f"<main><p>Head words of {k} are these.</p><div class='related-work'><p>Others did much of this before us, in year {k} and later.</p></div></main>"
    assert all("Others did" in t for t in texts(spark, [work(k) for k in range(3)]))


def test_other_evidence_beside_a_name(spark):
    said = "<p>The council voted on Monday to keep the library open all year.</p>"
    whole = "The council voted on Monday to keep the library open all year."
    links = "<div class='share-this'>Also of interest to those who came here: <a href='/a'>All that was ever said of libraries and of councils in one place.</a></div>"
    for noise in (links, "<div class='cookie-bar'><p>Accept all</p><p>Settings</p></div>", "<div class='comments'><p>I could not agree more with what is said.</p></div>"):
        assert texts(spark, [f"<div>{said}</div>{noise}"]) == [whole], noise
        assert texts(spark, [f"<article>{said}</article>{noise}"]) == [whole], noise
    outside = "<div class='sponsor-note'><p>This page is paid for by those who like to read it daily.</p></div>"
    assert texts(spark, [f"<article>{said}</article>{outside}"]) == [whole]
    inner = f"<div class='ad-wrapper'><article>{said}</article></div>"
    assert texts(spark, [inner]) == [whole]  # an article is not judged by what it stands in


def test_small_output_batches(spark):
    bodies = [f"<p>{'word ' * 50}{k}.</p><p>x</p>" for k in range(40)]
    df = spark.createDataFrame([(k, f"http://h{k}.com/", b) for k, b in enumerate(bodies)], "page_id long, url string, html string").coalesce(1)
    assert sorted(html_text.main_text(df, unpacked=100).collect()) == sorted(html_text.main_text(df).collect())
