"""Content written to be quoted: headings, questions, answers, images, readability."""

from pyspark.sql import functions as F

from geovis.functions.core import built_once
from geovis.operators.checks.registry import Check, describe, graded, yes_no

C = "content"
c = F.col

# The site facts that these checks read.
FACTS = [
    "h1_count", "title_length", "description_length", "heading_questions", "has_faq_words", "h2_questions",
    "h2_count", "direct_answers", "answer_questions", "image_alt_count", "image_count", "service_pages",
    "service_words", "home_words", "h3_count", "title", "reading",
]


@built_once
def checks() -> list[Check]:
    """The content checks."""
    h1 = F.when(c("h1_count") == 1, 2).when(c("h1_count") > 1, 1).otherwise(0)

    def length_points(length, low, high):
        return F.when(length.between(low, high), 2).when(length > 0, 1).otherwise(0)

    title = length_points(c("title_length"), 30, 65)
    description = length_points(c("description_length"), 110, 165)

    many = c("heading_questions") >= 3
    faq = (
        F.when(many & c("has_faq_words"), 3)
        .when(many | c("has_faq_words"), 2)
        .when(c("heading_questions") >= 1, 1)
        .otherwise(0)
    )

    h2_share = F.coalesce(F.try_divide(c("h2_questions"), c("h2_count")), F.lit(0.0))
    conversational = F.when(h2_share >= 0.3, 3).when(h2_share >= 0.15, 2).when(h2_share > 0, 1).otherwise(0)

    direct_share = F.coalesce(F.try_divide(c("direct_answers"), c("answer_questions")), F.lit(0.0))
    direct = F.when(direct_share >= 0.6, 2).when(direct_share >= 0.3, 1).otherwise(0)

    alt_share = F.coalesce(F.try_divide(c("image_alt_count"), c("image_count")), F.lit(0.0))
    alt = F.when(alt_share >= 0.8, 2).when(alt_share >= 0.5, 1).otherwise(0)

    words = F.when(c("service_pages") > 0, c("service_words")).otherwise(c("home_words").cast("double"))

    no_text = (c("reading.sentences") == 0) | (c("reading.words") == 0)
    readable = (F.try_divide(c("reading.words"), c("reading.sentences")) <= 25) & (
        F.try_divide(c("reading.chars"), c("reading.words")) <= 6.5
    )

    return [
        Check(
            "content_h1_unique", C, 2, "One main heading", graded(h1, 2), h1,
            describe(h1=c("h1_count")), "Use exactly one h1 per page.",
        ),
        Check(
            "content_heading_hierarchy", C, 2, "Sections under second level headings",
            *yes_no(c("h2_count") > 0, 2), describe(h2=c("h2_count"), h3=c("h3_count")),
            "Divide the page into sections with h2 headings.",
        ),
        Check(
            "content_title_tag", C, 2, "Title of 30 to 65 characters", graded(title, 2), title,
            describe(title=c("title"), length=c("title_length")), "Write a title of 30 to 65 characters.",
        ),
        Check(
            "content_meta_description", C, 2, "Description of 110 to 165 characters", graded(description, 2),
            description, describe(length=c("description_length")), "Write a description of 110 to 165 characters.",
        ),
        Check(
            "content_faq_structured", C, 3, "Questions as headings and an FAQ", graded(faq, 3), faq,
            describe(questions=c("heading_questions"), faq=c("has_faq_words")),
            "Add an FAQ with at least three full questions as headings.",
        ),
        Check(
            "content_conversational_density", C, 3, "Three in ten sections ask a question",
            graded(conversational, 3), conversational,
            describe(questions=c("h2_questions"), h2=c("h2_count")), "Phrase more h2 headings as questions.",
        ),
        Check(
            "content_answer_first", C, 2, "Answers come first",
            F.when(c("answer_questions") == 0, "skipped").otherwise(graded(direct, 2)), direct,
            describe(questions=c("answer_questions"), direct=c("direct_answers")),
            "Open the paragraph after each question with the answer.",
        ),
        Check(
            "content_alt_text", C, 2, "Images described",
            F.when(c("image_count") == 0, "skipped").otherwise(graded(alt, 2)), alt,
            describe(images=c("image_count"), described=c("image_alt_count")),
            "Describe every image in its alt attribute.",
        ),
        Check(
            "content_word_count", C, 1, "At least 500 words", *yes_no(words >= 500, 1, "warn"),
            describe(service_pages=c("service_pages"), home_words=c("home_words")),
            "Give the main pages at least 500 words of text.",
        ),
        Check(
            "content_readability", C, 1, "Short sentences and words",
            F.when(no_text, "skipped").when(readable, "pass").otherwise("warn"),
            F.when(~no_text & readable, 1).otherwise(0),
            describe(sentences=c("reading.sentences"), words=c("reading.words"), chars=c("reading.chars")),
            "Shorten sentences and prefer plain words.",
        ),
    ]
