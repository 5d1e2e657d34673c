"""Cases that earlier versions got wrong: speaker markers, vectors that share an id, comments, link lists and broken markup."""

import time

import pytest

from sparkloft.llm import chat
from sparkloft.llm.html_extract import main_text
from sparkloft.llm.pq_dedup import embedding_links

FORMS = ("{}: {}", "<|im_start|>{}\n{}", "**{}:** {}", "[{}] {}", "### {}: {}", "<|{}|> {}")
BODIES = ("Hello there", "Hello, how may I help you today?", "word " * 40, "One line.\nAnother line.\n\nA third?", "x")


@pytest.fixture(scope="module")
def models(spark):
    return chat.train(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


@pytest.mark.parametrize("role", chat.ROLES)
def test_markers_decide(models, role):
    """Each role, with each of its marker words in each form, as the opener and after another turn."""
    for model in models:
        for word in chat.MARKERS[role]:
            for form in FORMS:
                for body in BODIES:
                    for w in (word, word.capitalize()):
                        text = form.format(w, body)
                        seen = [chat.features(text, True), chat.features("Well, I see.", False), chat.features(text, False)]
                        lines = [f for row in seen for f in row]
                        states = chat.viterbi(model, model.scores(chat.np.array(lines)), True)
                        first, last = states[0], states[len(seen[0]) + len(seen[1])]
                        assert (chat.ROLES[first], chat.ROLES[last]) == (role, role), text


def test_clashing_columns_and_openers(spark, models):
    rows = [(1, 0, None, "Assistant: Hello, how may I help you today?"), (1, 1, None, "User: hi\nBot: x"), (2, 0, "user", "assistant: word word")]
    turns = spark.createDataFrame([(*r, 1, "a", "b", 2) for r in rows], "conv_id long, turn int, role string, text string, part int, rendered string, f string, state int")
    got = chat.format_turns(turns, models).collect()
    assert sorted((r["conv_id"], r["turn"], r["part"], r["role"]) for r in got) == [(1, 0, 0, "assistant"), (1, 1, 0, "user"), (1, 1, 1, "assistant"), (2, 0, 0, "assistant")]


def test_two_vectors_of_one_id(spark):
    rows = [(1, [1.0, 2.0, 0.5], 3), (1, [-1.0, -2.0, -0.5], 3), (2, [1.5, 3.0, 0.75], 3), (7, [0.0, 1.0, 9.0], 3)]
    got = embedding_links(spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, cls int, rep string")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (7, 0, 7, True)]


WORDS = "The long road, as it was then, led past the mill and over the hill to the sea, where boats lay. "


@pytest.mark.parametrize("name", ["comments", "comment-list", "reader-replies", "cookie-notice", "commentList", "ad-box", "gdpr consent"])
def test_long_comments_and_notices_go(name):
    article = "".join(f"<p>Part {i}. {WORDS * 3}</p>" for i in range(4))
    other = "".join(f"<p>Reply {i}, as I think, {WORDS * 3}</p>" for i in range(12))
    want = " ".join(f"Part {i}. {WORDS * 3}".strip() for i in range(4))
    assert main_text(f'<body><article>{article}<div class="{name}">{other}</div></article></body>') == want
    assert main_text(f'<body><div class="post">{article}</div><div class="{name}">{other}</div></body>') == want
    assert main_text(f'<body><main>{article}</main><section id="{name}">{other}</section></body>') == want


def test_such_a_class_around_the_page_drops_nothing():
    article = "".join(f"<p>{WORDS * 3}</p>" for i in range(4))
    want = " ".join([(WORDS * 3).strip()] * 4)
    for page in (f'<div class="comment-page">{article}</div>', f'<div class="has-comments"><article>{article}</article></div>', f'<div class="ads"><main>{article}</main></div>'):
        assert main_text(page) == want


def test_references_of_the_article_stay():
    links = "".join(f'<li><a href="/{i}">A study of roads and of their mills, volume {i}</a></li>' for i in range(5))
    menu = "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(5))
    got = main_text(f"<article><p>{WORDS * 4}</p><ul>{menu}</ul><h2>References</h2><ol>{links}</ol></article>")
    assert "Topic" not in got and got.count("A study of roads") == 5


@pytest.mark.parametrize("page", ["<b>" * 60000 + "</i>" * 60000, "<i><table>" + "<b>" * 60000 + "</i>" * 60000, "<b>" * 60000 + "<hr>" * 60000, "<article>" * 60000 + "x",
                                  '<div class="menu">' * 60000 + "x", "<ul><b>" + "<i>" * 60000 + "<li>" * 60000, "<p><b>" * 60000 + "</p>" * 60000])
def test_broken_markup_is_linear(page):
    began = time.process_time()
    main_text(page + "<p>text</p>")
    assert time.process_time() - began < 8
