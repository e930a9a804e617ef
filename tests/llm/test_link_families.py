"""Host families of the link filter: relatives meet in domains without pages."""

from inquiro.llm import link_filter


def test_relatives_meet(spark):
    pages = [(i, f"http://www.sib.net/fr/{i}", None) for i in range(5)] + [(10, "http://m.sib.net/en", None), (11, "http://a.b.sib.net/en", None), (12, "http://m.sib.net:8080/en", None)]
    pages += [(20 + i, f"http://shop{i}.com/", None) for i in range(40)] + [(70, "http://other.net/en", None), (71, "http://10.0.0.1/en", None)]
    pages += [(80, "http://www.far.co.uk/en", None), (81, "http://points.org/x", '<a href="http://sib.net/">x</a>')]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in link_filter.judge_urls(frame).collect()}
    assert {k for k, v in got.items() if v == "block"} == {0, 1, 2, 3, 4, 10, 11, 12, 81}
    hosts = spark.createDataFrame([(h,) for h in ("a.b.x.net", "x.net", "m.far.co.uk", "10.0.0.1", "", "net", "y.net:80", "far.co.uk")], "host string")
    up = {("a.b.x.net", "b.x.net"), ("b.x.net", "x.net"), ("m.far.co.uk", "far.co.uk"), ("y.net:80", "y.net")}
    assert {(r.src, r.dst) for r in link_filter.family_edges(hosts).collect()} == up | {(b, a) for a, b in up}
