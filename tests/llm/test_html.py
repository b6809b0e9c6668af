"""Main text of pages: layouts, odd markup and odd rows."""

import pytest
from brute import prose

from maskwork.llm.html_text import extract, main_text

P = [("This is the first paragraph of the article and it has all of the words that a reader would need to see in it. " * 2).strip(),
     "A second one, which is about the same thing but with other words, and it goes on for as long as it has to be for this.", "Short end."]
ARTICLE = "".join(f"<p>{p}</p>" for p in P)
WANT = "\n".join(P)
NOISE = ('<script>if (a < b) document.write("<p>no</p>")</script><style>p > a {color: red}</style><!-- <p>hidden</p> -->'
         '<noscript>enable it</noscript>')


@pytest.mark.parametrize("page, want", [
    (f"<html><body>{NOISE}<nav><a href=/>Home</a></nav><article><h1>Title here</h1>{ARTICLE}</article><footer>(c) 2020</footer></body>",
     "Title here\n" + WANT),
    (f"<body><div class='cookie-notice'><p>{P[0]}</p></div><main>{ARTICLE}</main><aside><p>{P[1]}</p></aside></body>", WANT),
    (f"<body><header><p>{P[0]}</p></header><div class=content>{ARTICLE}</div><div id=comments><p>{P[0]} I agree</p></div>", WANT),
    (f"<article>{ARTICLE}<div class='share-buttons'><a>Tweet</a></div><form><p>{P[1]}</p></form></article>", WANT),
    (f"<div class='layout has-sidebar'><article>{ARTICLE}</article><div class=sidebar><p>{P[0]}</p></div></div>", WANT),
    (f"<article>{ARTICLE}</article><section id='comments'><article class='comment'><p>{P[0]}</p></article></section>", WANT),
    (f"<article><p hidden>{P[0]}</p>{ARTICLE}<p style='display: none'>{P[1]}</p></article>", WANT),
    (f"<ul><li><a href=1>One link</a><li><a href=2>Two link</a></ul><p>{P[0]}<p>{P[1]}<p>{P[2]}<ul><li><a>x</a></ul>", "\n".join(P[:2])),
    (f"<article>{ARTICLE}", WANT),
    ("<article><p>a &amp; b&nbsp;&#233; &lt;i&gt;\n\t  c<br>d</p></article>", "a & b é <i> c d"),
    ("<article><p><b>one <p>two</b> three</article>", "one\ntwo three"),
    ("<article>5 < 6 and a<b>c</b></article>", "5 < 6 and ac"),
    ("", ""), (None, ""), ("<p", ""), ("<!-- open", ""), ("<script>never closed <p>x</p>", ""), ("<article></article></div></p>", ""),
])
def test_layouts(page, want):
    assert main_text(page) == want


RU = ["Сегодня утром жители города вышли на набережную, чтобы посмотреть, как река медленно освобождается от зимнего льда. " * 2,
      "Старый мост закрыли ещё осенью, поэтому теперь все ходят через парк и подолгу стоят у перил, глядя на воду и птиц."]
PL = ["Rano mieszkańcy miasta wyszli nad brzeg rzeki, żeby zobaczyć, jak lód powoli pęka i spływa pod starym mostem ku morzu. " * 2,
      "Most zamknięto jeszcze jesienią, więc teraz wszyscy chodzą przez park, stoją przy barierkach, patrzą długo ku wodzie."]
ZH = ["今天早上，城里的居民来到河边，看冰雪慢慢融化，河水重新流动起来，孩子们在岸边奔跑，老人们坐在长椅上聊天，说着往年春天的故事，也说起那座老桥和桥边的茶馆。" * 2,
      "老桥去年秋天就关闭了，所以现在大家都从公园里走过去，在栏杆旁站很久，看着河水和飞鸟，直到太阳完全升起来。"]


@pytest.mark.parametrize("parts", [RU, PL, ZH])
def test_languages_without_stop_words(parts):
    text = "".join(f"<p>{p.strip()}</p>" for p in parts)
    menu = "<ul><li><a href=1>Главная Strona 首页</a><li><a href=2>Контакты</a></ul>"
    want = "\n".join(p.strip() for p in parts)
    assert main_text(f"<body>{menu}<div>{text}</div><div class=sidebar><p>{parts[0]}</p></div>{menu}</body>") == want
    assert main_text(f"<body><div>{text}</div><p>All rights are with the owner of this site and we use it as it is.</p></body>").startswith(want)


@pytest.mark.parametrize("page, want", [
    (f"<body><form id=aspnetForm><div class=nav><a>Home</a></div><div>{ARTICLE}</div></form></body>", WANT),
    (f"<body><form><main>{ARTICLE}</main><aside><p>{P[1]}</p></aside></form></body>", WANT),
    (f"<div class='content-sidebar-wrap'><main>{ARTICLE}</main><div class=sidebar><p>{P[0]}</p></div></div>", WANT),
    (f"<div class='related-layout'><form><article>{ARTICLE}<form><p>{P[1]}</p></form></article></form></div>", WANT),
    (f"<article>{ARTICLE}</article><div class=related><article><p>{P[0]}</p></article></div>", WANT),
    (f"<div>{ARTICLE}</div><section id=comments>" + f"<article><p>{P[0]}</p></article>" * 5 + "</section>", WANT),
    (f"<div id=comments><p>{P[0]}</p></div>", ""), (f"<div hidden><form><p>{P[0]}</p></form></div>", ""),
])
def test_wrappers(page, want):
    assert main_text(page) == want


def test_long_and_deep_pages():
    text = prose(1, 100_000)
    assert main_text(f"<article><p>{text}</p></article>") == text
    assert main_text("<div>" * 50_000 + f"<article><p>{P[0]}</p></article>") == P[0]
    assert main_text("<article><p class='" + "x" * 100_000 + f"'>{P[0]}</p></article>") == P[0]
    main_text("<a href='" * 3000 + f">x</a><article><p>{P[0]} tail</p></article>")  # ends, whatever it finds


def test_attributes_of_any_length_and_stray_quotes():
    for n in (19_000, 21_000, 300_000):
        for quote in "\"'":
            state = f"{{a > b}} <p>{'x' * n}</p>"
            assert main_text(f"<article><p data-state={quote}{state}{quote}>{P[0]}</p></article>") == P[0]
    assert main_text(f"<article><p title=it's>{P[0]}</p><p>{P[1]} it's so</p></article>") == f"{P[0]}\n{P[1]} it's so"
    assert main_text(f"<article><p>{P[0]}</p><p class=") == P[0]
    main_text("<p x=" * 200_000)  # ends soon
    main_text('<p x="' * 200_000)


def test_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x", 5), (1, "u", f"<article>{ARTICLE}</article>", "x", 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (None, None, "", 0)], key=repr)
    assert extract(df.limit(0)).count() == 0
