"""Names of comments around, on, beside and inside an article."""

import pytest
from motionlake.llm.html_text import main_text

BODY = "<p>" + "This is the story of the house and of those who lived in it for many years. " * 6 + "</p>"
TALK = "<p>" + "I like the story and what you have said of it, and so does my friend. " * 6 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="comments-open"><article>{body}</article></div>',
        '<div class="respond"><article>{body}</article></div>',
        "<article class=comments>{body}</article>",
        '<body class="single comments-closed"><article>{body}</article></body>',
        '<div id="comments"><main>{body}</main></div>',
        '<article>{body}</article><section id="comments"><article class="comment">{talk}</article></section>',
        '<article>{body}<div class="comments-area">{talk}</div></article>',
        '<article>{body}</article><div class="post-comments"><article>{talk}</article></div>',
        '<article>{body}</article><article class="comment">{talk}</article>',
        '<div class="comments"><nav><article>{talk}</article></nav></div><article>{body}</article>',
    ],
)
def test_comments_go_and_the_article_stays(page):
    assert main_text(page.format(body=BODY, talk=TALK)) == main_text(f"<article>{BODY}</article>")


def test_ids_of_other_types_are_cast(spark, sf_dir):
    """op2, op3 and op6 take ids of any type that reads as a number."""
    from motionlake.llm import language
    from motionlake.llm.common import table
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    for kind in ("int", "string"):
        odd = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
        model = language.fit(odd, odd.select("doc_id", F.col("lang").alias("label")), F.lit(True))
        assert dict(language.identify(odd, model).dtypes)["doc_id"] == "bigint"
        assert language.identify(odd, model).where("lang_pred IS NULL OR doc_id IS NULL").count() == 0
