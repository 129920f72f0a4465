from pyspark.sql import functions as F

from narrascope.functions import page as P
from narrascope.plans import flows

POST = ('<html><head><title>Ann on X: "title text"</title></head><body><article><div class="a" data-testid="tweetText"><span>Hello &amp; #world '
        'see https://t.co/x @you</span></div><div data-testid="videoPlayer"></div><span data-testid="like">12K</span></article></body></html>')
TITLE = '<html><head><meta content="Bob on X: &quot;quoted words&quot; / X" property="og:title"><title>other</title></head><body></body></html>'
SPANS = "<html><body><span>Log in</span><span>some long text in a span</span><span>more</span></body></html>"
GONE = "<html><head><title></title></head><body>Account SUSPENDED</body></html>"
BLANK = '<html><head><title>a title here</title></head><body><div data-testid="tweetText"> </div></body></html>'


def records(spark, **options):
    pages = spark.createDataFrame(list(enumerate([POST, TITLE, SPANS, GONE, BLANK])), "id int, html string")
    return {int(r.tweet_id): r for r in flows.extract_records(pages, **options).collect()}


def test_cascade(spark):
    got = records(spark)
    assert [got[i].text for i in range(5)] == ["Hello & #world see https://t.co/x @you", "quoted words", "some long text in a span more", "", "a title here"]
    assert [got[i].hydration_score for i in range(5)] == [7, 2, 2, 0, 2]
    assert [got[i].fail_reason for i in range(5)] == ["", "", "", "account_suspended", ""]
    assert records(spark, compat=True)[4].hydration_score == 5


def test_page_parts(spark):
    got = records(spark)
    assert (got[0].hashtags, got[0].has_link, got[0].media, got[0].likes, got[0].views) == ("#world", "yes", "yes", "12K", None)
    assert (got[1].media, got[1].likes) == ("no", None)
    na = spark.createDataFrame([(None,)], "v string").select(P.metric_or_na(F.col("v"))).first()[0]
    assert na == "N/A"


def test_nested_elements_are_whole(spark):
    pages = {
        '<p><div data-testid="tweetText"><div>one</div> two <b>three</b></div> rest</p>': "one two three",
        '<DIV class="x" data-testid="tweetText">a<div>b<div>c</div></div>d</DIV><div>e</div>': "a b c d",
        '<div data-testid="tweetText">never <div>closed</div>': "never closed",
        '<section><article data-testid="tweetText"><article>in</article>out<div/></article></section>': "in out",
        '<div data-testid="tweetText"><divider>kept</divider> too</div>': "kept too",
        "<p>none</p>": None,
    }
    found = spark.createDataFrame([(h,) for h in pages], "h string").select(
        "h", P.inner_text(P.element_html(F.col("h"), r"\w+", 'data-testid="tweetText"')).alias("t")).collect()
    assert {r.h: r.t for r in found} == pages
    spans = {"<span>aa <span>bb</span> cc</span><span>d</span>": ["aa bb cc", "bb", "d"], "<spanner>x</spanner>": [],
             "x<span a='1'>y": ["y"], "<SPAN><b>z</b></SPAN>": ["z"], "<span/>w": []}
    found = spark.createDataFrame([(h,) for h in spans], "h string").select("h", P.spans(F.col("h")).alias("s")).collect()
    assert {r.h: r.s for r in found} == spans


def test_search_text_is_made_once(spark):
    from narrascope.plans import flows

    rows = [("1", "<p>Tweet Unavailable</p>"), ("2", "<article>good words #tag http://x</article>"), ("3", None)]
    records = flows.extract_records(spark.createDataFrame(rows, "id string, html string"), text_tag="article", text_attribute="")
    search = records.select("fail_reason")._jdf.queryExecution().optimizedPlan().toString().count("lower(concat_ws( , html")
    assert search == 1 and [r.fail_reason == "" for r in records.orderBy("tweet_id").collect()][1]
