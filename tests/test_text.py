"""Scalar functions on the fixtures of the reference's own tests, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import models, stem, topics
from gleaner.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    def run(expression, **columns):
        frame = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns)) if columns else spark.range(1)
        return frame.select(expression.alias("v")).first().v

    return run


@pytest.mark.parametrize(
    "text,want",
    [
        ("", "Empty snippet"), ("  \n ", "Empty snippet"), ("[2025-11-01 ERROR job::queue] failed", "Error in job"), ("ERROR: disk full", "Note: ERROR: disk full"), ("x ERROR a: disk full", "Error: disk full"), ("WARN low space", "Warning: low space"),
        ("$ ls -la", "$ ls -la"), ("git push origin", "$ git push origin"), ("def run(x):", "Function: def"), ("use std::fs;", "Import: std"), ("class Foo:", "Type: Foo"), ("https://example.com/docs/a", "Link: example.com/docs"), ("https://example.com", "Link: example.com"),
        ("Compiling a\nCompiling b", "Build: Compiling 2 crates"), ("Finished dev profile unoptimized", "Build: Finished (dev)"), ("✅ ENGINE up", "Log: Model loaded"), ("**bold** plain", "Note: bold plain"),
    ],
)
def test_summaries(value, text, want):
    assert value(T.rule_summary(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("function test() {\n  const x = 10;\n  return x;\n}", "Code Snippets"), ("Check out https://example.com for more info", "Links"), ("Random text without specific keywords", "Quick Notes"),
        ("How to Activate Plan Mode: a guide to plan mode with const and class words", "Documentation"), ("docker run x", "Docker Commands"),
    ],
)
def test_keyword_category(value, text, want):
    assert value(T.keyword_category(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    "command,want",
    [*((c, False) for c in ("ls", "cd /home", "pwd", "clear", "", "echo")), *((c, True) for c in ("docker ps", "git status", "kubectl get pods", "npm install", "x" * 40, "a | b", "a && b", "a || b", "a > b", "a >> b", "sudo apt update", "mv file1.txt file2.txt", "rm -rf temp"))],
)
def test_command_filter(value, command, want):
    assert value(T.worth_saving(F.col("x")), x=command) is want


def test_cleaning(value):
    assert value(T.clean_minimal(F.col("x")), x="  Line 1  \n\n  Line 2  \n  \n") == "  Line 1  \n  Line 2  "
    assert value(T.clean_balanced(F.col("x")), x="  Line 1  \n\n  Line 2  \n  \n  Line 3  ") == "Line 1\nLine 2\nLine 3"
    assert value(T.clean_balanced(F.col("x")), x="menu\n3:45 PM\n***\nreal   text\nx") == "real text"
    assert value(T.clean_screenshot(F.col("x")), x="GLEDGIAEM\nOnline\nreal text here\nohj-vaap-ihp") == "real text here"
    assert value(T.fix_confusion(F.col("x")), x="l and O “q” – …") == '1 and 0 "q" - ...'
    assert value(stem.nfc(F.col("x")), x="é") == "é"


def test_entities(value):
    got = value(T.entities(F.col("x")), x="Visit https://example.com or www.test.com\n$ ls -la\nmail a.b@c.org see /usr/local/bin getValue() callMe")
    assert got.urls == ["https://example.com", "www.test.com"] and got.emails == ["a.b@c.org"] and "/usr/local/bin" in got.file_paths
    assert got.commands == ["$ ls -la"] and "callMe" in got.code_snippets


def test_structure_and_types(value):
    assert value(T.structure(F.col("x")), x="function test() {\n  const x = 10;\n  return x;\n}") == "Code"
    assert value(T.structure(F.col("x")), x="- a\n- b\n- c") == "List" and value(T.structure(F.col("x")), x="") == "Plain"
    assert value(T.structure(F.col("x")), x="$ ls\n$ pwd\nout") == "Terminal" and value(T.structure(F.col("x")), x="a|b|c\nd|e|f\ng|h|i") == "Table"
    assert value(T.caption_type(F.col("x")), x="pdf: a page") == "Document" and value(T.caption_type(F.col("x")), x="nothing here") == "General"
    assert value(T.content_type(T.structure(F.col("x"))), x="- a\n- b\n- c") == "Document"


def test_screenshots(value):
    both = lambda c, t: value(T.combine_screenshot(F.col("c"), F.col("t")), c=c, t=t)
    assert both("Just a caption", "") == "[Caption: Just a caption]" and both(None, "Just OCR text") == "[Text: Just OCR text]" and both("", " ") == "[Screenshot]"
    split = value(T.split_screenshot(F.col("x")), x="[Caption: a [b] c] [Text: d]")
    assert (split.caption, split.text) == ("a [b] c", "d")
    assert [value(T.image_file(F.col("x")), x=f"test.{e}") for e in ("png", "JPG", "jpeg", "webp", "txt", "pdf")] == [True] * 4 + [False] * 2
    assert [value(T.browser_app(F.col("x")), x=a) for a in ("Google Chrome", "Firefox", "Safari", "Microsoft Edge", "Terminal", "VS Code")] == [True] * 4 + [False] * 2
    assert value(T.screenshot_summary(F.col("c"), F.col("t")), c="Screenshot at 1", t="words") == "words"


def test_names(value):
    assert value(T.normalize_category(F.col("x")), x=" My_Cool-Name  x ") == "my cool name x"
    assert value(T.without_emoji(F.col("x")), x="📚 Docs ⚙️") == "Docs"
    assert value(T.similarity(F.col("a"), F.col("b")), a="Docs", b="docs") == 1 and value(T.similarity(F.col("a"), F.col("b")), a="doc", b="docker") == 0.5
    assert value(T.command_family(F.col("x")), x="docker-compose up").name == "Docker Commands" and value(T.command_family(F.col("x")), x="foo") is None
    assert value(T.app_emoji(F.col("x")), x="Safari") == "🌐" and value(T.app_emoji(F.col("x")), x="Other") == "📱"
    assert value(T.parse_decision(F.col("x")), x='Sure: {"action": "create_new", "name": "🎉 Docs", "confidence": "0.9"} ok') == ("create_new", "Docs", 0.9)
    assert value(T.answer_summary(F.col("x")), x='{"summary": "short one", bad') == "short one"
    assert value(T.first_sentences(F.col("x"), 2, 100), x="One. Two! Three?") == "One. Two!"


def test_dates(value):
    for text in ("2025-01-02T03:04:05Z", "2025-01-02 03:04:05", "2025-01-02 03:04:05.000000"):
        assert str(value(T.parse_timestamp(F.col("x")), x=text)) == "2025-01-02 03:04:05"
    assert value(T.parse_timestamp(F.col("x")), x="soon") is None
    at = lambda m: value(T.relative_date(F.expr(f"timestamp '2024-01-10 12:00:00' - interval {m} minutes"), F.expr("timestamp '2024-01-10 12:00:00'")))
    assert [at(5), at(130), at(1500), at(4400)] == ["5m ago", "2h ago", "Yesterday", "3d ago"]


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "relational": "relat", "digitizer": "digit", "goodness": "good", "controll": "control", "sky": "sky", "é": "é"}
    assert {w: stem.porter(w) for w in pairs} == pairs


def test_topics():
    assert topics.topic_of("The query planner is a part of it") == "About: query planner"
    assert topics.topic_of("Get better results from your team today ok") == "Get better results from your team"
    assert topics.topic_of("a b") is None


def test_images():
    image = np.repeat(np.array([10, 12, 200, 210], np.uint8), 50).reshape(10, 20)
    assert 12 <= models.otsu_threshold(image) < 200
    assert set(np.unique(models.binarized(image))) == {0, 255}
    assert models.equalized(image).max() == 255
