import random

from llm_helpers import prose, words
from listwright.llm import html


def test_prose_outside_articles_stays(spark):
    rnd = random.Random(11)
    menu, story = " ".join(words(rnd, 12)), prose(rnd, 60)
    few = [" ".join(words(rnd, 4)) for _ in range(60)]
    body = [" ".join(rnd.sample(few, 8)) for _ in range(100)]
    rows = [(k, f"http://a.b/{k}", f"<div>{menu}</div><div>{body[k]}</div><div>{menu} only {k}</div>") for k in range(100)]
    rows += [(200 + k, f"http://a.b/s{k}", f"<div>{menu}</div><div>{story}</div>") for k in range(4)]
    rows += [(300 + k, f"http://c.d/{k}", f"<div>{story}</div>") for k in range(4)]
    got = html.extract(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[300 + k] == story and text[200 + k] == story for k in range(4))
    assert all(text[k].split("\n") == [body[k], str(k)] for k in range(100))
