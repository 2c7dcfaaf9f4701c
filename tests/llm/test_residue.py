from carex.llm import residue as R

DIFF = "\n\ndiff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+{{summary}} ${SCOPE} lorem ipsum\n"
CASES = [
    "{{summary}}" + DIFF, "Fix x [[insert title here]]" + DIFF, "Fix x\n\nTicket: @@ISSUE_KEY@@" + DIFF, "${TYPE}(%SCOPE%): <summary>" + DIFF,
    "TODO: write a summary" + DIFF, "Lorem ipsum dolor sit amet consectetur adipiscing elit." + DIFF, "todo todo todo todo", "Title goes here\nBody goes here" + DIFF,
    "404 Not Found\n\nThe page moved.", '{"message":"Not Found","status":404,"request":"ab12"}', "fatal: bad object 0123456789", "Fix x\n\n[diff could not be loaded: 503 Service Unavailable]",
    "Please enable JavaScript to view this diff.", "<noscript>Activez JavaScript</noscript>\n<div id=\"root\"></div>", "Veuillez activer JavaScript pour afficher ce commit.",
    "﻿commit 0123456789abcdef\r\nAuthor: A <a@b.c>\r\nDate: 2020\r\n\r\n    {{summary}}\r\n",
]
NEGATIVES = [
    "Fix x in y" + DIFF, "Drop the commit template with its {{summary}} line" + DIFF, "Fix 502 Bad Gateway after restart" + DIFF, "Return 404 Not Found when missing" + DIFF,
    "Replace lorem ipsum in the guide with real copy" + DIFF, "Add noscript notice to the page\n\nReaders without scripts saw an empty page." + DIFF, "Document the <widget> argument of panel\n\nUsage: panel <widget> [options]" + DIFF,
    "Expand ${QUEUE_HOME} before opening the export" + DIFF, "Merge branch 'x' into main", "", "   \n", None,
]


def found(spark, texts, **k):
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in enumerate(texts)], "doc_id long, text string, kind string, key string")
    return {r.doc_id for r in R.residue_documents(df, **k).collect()}


def varied(text, k):
    """The same residue in a record of other content."""
    return text.replace("-a\n", f"-a{k}\n").replace("The page moved.", f"The page {'abc'[k]} moved.").replace("ab12", f"ab{k}2").replace("Fix x", f"Fix {'xyz'[k]}")


def test_cases_and_negatives(spark):
    cases = [varied(t, k) for t in CASES for k in range(3)]
    slots = ["{{insert title here}}" + DIFF, "{{issue key}}" + DIFF, "{{type}}" + DIFF, "${scope}" + DIFF]  # other delimiters
    assert found(spark, cases + slots + NEGATIVES) == set(range(len(cases) + len(slots)))


def test_what_only_one_record_shows_is_content(spark):
    """Prose on scripts or error pages, and patterns that no other record repeats."""
    prose = "This page requires JavaScript to render the chart, so load it lazily" + DIFF
    copies = [f"commit {k}123456789abcdef\nAuthor: A <a@b.c>\n\n    " + prose for k in range(4)]
    page = ["404 Not Found\n\nThe page moved.", "404 Not Found\n\nReturn it when a row is missing."]
    assert found(spark, [prose, *copies, *page, "TODO: write a summary" + DIFF]) == set()


def test_pages_are_aligned_line_by_line(spark):
    pages = [f"404 Not Found\n\nThe object {w} you asked for is gone.\nReference: #{k}" for k, w in enumerate(("cache", "anchor", "limit"))]
    long = "\n".join(["404 Not Found", *[f"The object {w} you asked for is gone." for w in "a b c d e f g h i j k l m n o p".split()]])
    other = "404 Not Found\n\nThe object cache you asked for is gone.\nHandlers now return it for absent rows."
    assert found(spark, [*pages, long, other]) == {0, 1, 2, 3}


def test_long_names_and_labels(spark):
    name, label = "describe " + "very " * 20 + "carefully", "Notes of " + "the " * 12 + "release"
    left = [f"Fix {v}\n\n{label}: {v}" + DIFF for v in ("A-1", "B-22")] + [f"Fix x\n\n{label}: {{{{{name}}}}}" + DIFF]
    assert found(spark, left) == {2}


def test_names_are_induced_from_the_corpus(spark):
    left = ["{{flurb_name}}" + DIFF, "Fix it ${flurb name}" + DIFF, "[[Flurb.Name]]" + DIFF]
    once = ["Fix it {{quux}}" + DIFF]
    assert found(spark, left + once) == {0, 1, 2}


def test_titles_are_induced_from_repeated_pages(spark):
    page = "<html>\n<head><title>{}</title></head>\n<body>\n<h1>{}</h1>\n</body>\n</html>"
    titles = ["Upstream is asleep", "Upstream is asleep", "Gone fishing"]
    texts = [page.format(t, t) for t in titles] + ["Upstream is asleep\n\nTry again."] + ["Upstream is asleep" + DIFF]
    assert found(spark, texts) == {0, 1, 2, 3}


def test_long_texts_repeats_and_empty_tables(spark):
    long = "Fix x" + DIFF + "+y\n" * 200_000
    assert found(spark, [long, "{{summary}}\n" + "word " * 200_000, "[[summary]]", "{{summary}}"]) == {1, 2, 3}
    assert found(spark, []) == set()


def test_names_are_induced_from_aligned_lines(spark):
    left = [f"Fix x\n\nTicket: {v}" + DIFF for v in ("A-1", "B-22", "{{flurb}}")]
    sole = ["Fix x\n\nNote: {{flurb2}}" + DIFF]
    fixed = [f"Fix {k}\n\nSee: {{{{zork}}}}" + DIFF for k in range(3)]
    assert found(spark, left + sole + fixed) == {2}


def test_forms_are_aligned_by_their_labels(spark):
    form = "Summary: {}\n\nTest plan: {}\n\nReviewers:"
    blank = ["Summary:\n\nTest plan:\n\nReviewers:" + DIFF]
    kept = [form.format("What this does", "How you know") + DIFF.replace("-a", f"-{k}") for k in range(3)]
    own = [form.format(f"Fix {k}", f"Ran {k}") + DIFF for k in range(3)]
    copied = [form.format("Fix again", "Ran again") + DIFF] * 3
    mixed = [form.format("Fix z", "How you know") + DIFF, "Fix y\n\nTest plan:\n\nReviewers:" + DIFF]
    assert found(spark, blank + kept + own + copied + mixed) == {0, 1, 2, 3}
    assert found(spark, ["Goal:\n\nRisk:\n" + DIFF.replace("-a", f"-{k}") for k in range(3)] + ["Plan:\n\nRisk:\n" + DIFF]) == {0, 1, 2}


def test_whole_pages_are_compared(spark):
    head = "<html>\n<head>\n" + '<meta name="viewport" content="width">\n' * 12
    other = [head + f"<title>Guide {w}</title></head>\n<body>\n<p>About {w} {w}.</p>\n</body>\n</html>" for w in ("apples", "pears", "plums")]
    page = head + "<title>{}</title></head>\n<body>\n<h1>{}</h1>\n</body>\n</html>"
    same = [page.format(t, t) for t in ("Upstream is asleep", "Upstream is asleep", "Gone fishing")]
    long = ["Gone fishing\n" + "Back at some time.\n" * 20]
    assert found(spark, other + same + long) == {3, 4, 5, 6}
