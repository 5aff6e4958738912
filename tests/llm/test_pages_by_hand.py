"""Pages of varied make, each with the text that a reader would take for its own, marked by hand."""

import pytest

from loomline.llm import html_extract

S = [
    "The harbour was closed for three days after the storm, and no ship came in.",
    "On the fourth day the pilots went out again, although the sea was still high.",
    "Most of the damage was done to the old pier, which the town will now replace.",
    "Nobody was hurt, but several boats were lost, among them the one of the mayor.",
]
TEXT = "\n".join(S)
P = "".join(f"<p>{s}</p>" for s in S)
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sports</a></li></ul>"
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Another story of the day {i}</a></li>" for i in range(6)) + "</ul>"
FOOT = "<p>Copyright 2024 The Harbour News.</p><a href=/i>Imprint</a> <a href=/p>Privacy</a>"
READER = "<p>I was there and it was much worse than you say, as all of us could see.</p>"

#: name: (page, its text).
PAGES = {
    "head and body not closed": (f"<html><head><title>t</title><article>{P}", TEXT),
    "no head, no body, no html": (f"<title>t</title><article>{P}</article>", TEXT),
    "head not closed, then meta, then text": (f"<head><meta charset=utf-8><link rel=x href=y><style>p{{}}</style><script>var a='<p>'</script><main>{P}</main>", TEXT),
    "body says that it has a navigation": (f"<html><body class='has-navbar'><nav>{MENU}</nav><article>{P}</article></body></html>", TEXT),
    "body says where its sidebar is": (f"<body class='right-sidebar'><div id=content>{P}</div><div class=sidebar>{LINKS}</div></body>", TEXT),
    "body with many words of state": (f"<body class='single single-post logged-out header-image sidebar-content no-comments'><main><article>{P}</article></main></body>", TEXT),
    "an article that is open for comments": (f"<body><article class='post comments-open'>{P}</article></body>", TEXT),
    "a wrapper with a banner": (f"<body><div class='page with-banner'><h1>After the storm</h1>{P}</div></body>", "After the storm\n" + TEXT),
    "a data attribute that says hidden": (f'<body><article data-title="The hidden cost of storms" data-x=\'display: none\'>{P}</article></body>', TEXT),
    "one form around the page": (f"<body><form id='aspnetForm' method=post><input type=hidden name=v><div id=main>{P}</div></form></body>", TEXT),
    "a wrapper named after what it holds": (f"<body><div class='content-sidebar-wrap'><main>{P}</main><aside class=sidebar>{LINKS}</aside></div></body>", TEXT),
    "a choice within a sentence": (f"<article><p>{S[0][:20]} <select><option>a<option selected>b</select>{S[0][20:]}</p>{P}</article>", f"{S[0][:20]} {S[0][20:]}\n{TEXT}"),
    "a drawing within a sentence": (f"<article><p>{S[0][:20]}<svg><title>x</title><text>y</text></svg>{S[0][20:]}</p>{P}</article>", f"{S[0]}\n{TEXT}"),
    "a choice that is never closed": (f"<body><div class=search><select><option>a<option>b</div><article><video src=x><div>{P}</div></video>{P}</article><main><select><div></main><section>{P}</section>", TEXT + "\n" + TEXT),
    "header, navigation, sidebar and footer": (f"<body><header><h2>Harbour News</h2></header><nav>{MENU}</nav><main><h1>After the storm</h1>{P}</main><aside>{LINKS}</aside><footer>{FOOT}</footer></body>", "After the storm\n" + TEXT),
    "the same by classes": (f"<body><div class=masthead>Harbour News</div><div class='main-menu'>{MENU}</div><div class=entry><h1>After the storm</h1>{P}</div><div class=related-posts>{LINKS}</div><div class=site-footer>{FOOT}</div></body>", "After the storm\n" + TEXT),
    "the same by ids": (f"<body><div id=header>Harbour News</div><div id=nav>{MENU}</div><div id=content><h1>After the storm</h1>{P}</div><div id=sidebar>{LINKS}</div><div id=footer>{FOOT}</div></body>", "After the storm\n" + TEXT),
    "the same by roles": (f"<body><div role=navigation>{MENU}</div><div role=main><h1>After the storm</h1>{P}</div><div role=complementary>{LINKS}</div><div role=contentinfo>{FOOT}</div></body>", "After the storm\n" + TEXT),
    "comments of readers": (f"<body><article>{P}</article><section id=comments><h3>Comments</h3>{READER * 3}</section></body>", TEXT),
    "more comments than text": (f"<body><article>{P}</article><section id=comments><h3>Comments</h3>{READER * 40}</section></body>", TEXT),
    "comments that are articles": (f"<body><main>{P}</main><ol class=commentlist>" + f"<li><article class=comment>{READER}</article></li>" * 12 + "</ol></body>", TEXT),
    "a notice on cookies": (f"<body><div class='cookie-consent'><p>We and our many partners use cookies in order to make this site better for you.</p><button>Accept</button></div><article>{P}</article></body>", TEXT),
    "a notice over the page": (f"<body><div class=modal-overlay style='z-index: 9'><p>Subscribe now and get the first month for free, as long as you like.</p></div><main>{P}</main></body>", TEXT),
    "an advert between paragraphs": (f"<article><p>{S[0]}</p><div class='ad-slot'><p>Buy a boat now, cheap and good, from the best in town.</p></div><p>{S[1]}</p><p>{S[2]}</p></article>", "\n".join(S[:3])),
    "a newsletter form at the end": (f"<article>{P}<form class=newsletter><label>Your address</label><input name=a><button>Subscribe</button></form></article>", TEXT),
    "hidden parts": (f"<article><p hidden>Nobody should read this line of text at all, ever.</p><div style='display : none'><p>Nor should anybody read this line of text.</p></div>{P}</article>", TEXT),
    "a heading within an article's header": (f"<article><header><h1>After the storm</h1></header>{P}</article>", "After the storm\n" + TEXT),
    "line breaks and entities": ("<article><p>The harbour&nbsp;&mdash; closed\n for three days &#40;or four&#x29; &amp; more &lt;days&gt; &eacute;t&eacute;,<br>as some said &zzz; later on.</p></article>", "The harbour — closed for three days (or four) & more <days> été, as some said &zzz; later on."),
    "a table of figures": (f"<main>{P}<table><tr><td>Boats lost in the storm, by the harbour's own count, were seven.</td></tr><tr><td>Boats found again in the days that followed were only two.</td></tr></table></main>", TEXT + "\nBoats lost in the storm, by the harbour's own count, were seven.\nBoats found again in the days that followed were only two."),
    "a list of points": (f"<article>{P}<ul><li>The pier will be built again, of stone this time, says the town.</li><li>The lighthouse stands and needs nothing but some paint on its door.</li></ul></article>", TEXT + "\nThe pier will be built again, of stone this time, says the town.\nThe lighthouse stands and needs nothing but some paint on its door."),
    "paragraphs that are never closed": ("<body><main>" + "".join(f"<p>{s}" for s in S), TEXT),
    "capital tags and bare attributes": ("<BODY><MAIN CLASS=Article>" + "".join(f"<P ALIGN=left>{s}</P>" for s in S) + "</MAIN></BODY>", TEXT),
    "only a menu": (f"<body><nav>{MENU}</nav></body>", ""),
    "nothing": ("<html><head><title>t</title></head><body></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_a_page_marked_by_hand(name):
    page, wanted = PAGES[name]
    assert html_extract.main_text(page, html_extract.Classifier()) == wanted


def test_with_what_the_test_pages_teach(spark, sf_dir):
    taught = html_extract.learn(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    wrong = {name: (html_extract.main_text(page, taught), wanted) for name, (page, wanted) in PAGES.items()}
    assert {name: x for name, x in wrong.items() if x[0] != x[1]} == {}


def test_attributes():
    given = """ class='a b' ID=x hidden data-y="hidden style='display:none'" style = "color: red" class=c 'stray' title="a > b" /"""
    assert html_extract.attributes(given) == {"class": "a b", "id": "x", "hidden": "", "data-y": "hidden style='display:none'", "style": "color: red", "stray": "", "title": "a > b"}
