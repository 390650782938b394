"""The labelled table of text blocks: small pages whose main text begins with ``+`` and the rest with ``-``.

Some pages are written out, to show regions by name. Most are made by a seeded rule and name nothing:
there numbers of words, links and neighbours decide.
"""

import random

_LONG = "words of a longer paragraph that goes on for a while, names a few things and comes to an end."

_WRITTEN = (
    # articles in semantic markup, with short and long paragraphs, lists and links inside the text
    f"""<html><head><title>x</title></head><body><header>- The Daily Page</header><nav><ul><li><a href=/>- Home</a><li><a href=/n>- News</a>
    <li><a href=/s>- Sport and more</a></ul></nav><article><h1>+ A headline of six words here</h1><p>+ {_LONG} {_LONG}<p>+ To.<p>+ Short one.
    <p>+ {_LONG}<h2>+ Part two</h2><ul><li>+ first point<li>+ second point</ul><p>+ <a href=/a>one linked paragraph</a></article>
    <aside><h3>- Most read</h3><a href=/1>- Ten things to know</a><p>- {_LONG}</p></aside><footer>- &copy; 2020 Daily Page. {_LONG}</footer></body></html>""",
    f"""<body><div class="ad">- Buy now, only today.</div><div class="cookie-notice"><p>- We use cookies. {_LONG}</p><button>ok</button></div><article>
    <h1>+ Short title</h1><p>+ It.<p>+ {_LONG}</p><div class="ad">- Advertisement</div><div class="share">- <a href=#>Share</a></div><p>+ The end.</p>
    <section class="comments"><h3>- Two comments</h3><p>- {_LONG}</p><p>- I agree with that.</p></section></article>
    <div class="sidebar"><p>- {_LONG} {_LONG}</p><ul><li><a href=#>- link one</a><li><a href=#>- link two</a></ul></div></body>""",
    f"""<body><main><header><h1>+ Title in a header</h1></header><p>+ {_LONG}</p><blockquote>+ A quoted line.</blockquote><table><tr><td>+ cell
    <td>+ value 3</table><form><label>- Your mail</label><p>- {_LONG}</p></form><p>+ Last words.</p></main><footer><p>- Contact us</p><a href=#>- Imprint</a>
    </footer></body>""",
    # no semantic elements: regions are named by classes and ids
    f"""<body><div id="header">- Site name</div><div id="menu"><a href=/1>- One</a> <a href=/2>Two</a> <a href=/3>Three</a></div><div id="content">
    <h1>+ What happened</h1><p>+ {_LONG}</p><p>+ Yes.</p><p>+ {_LONG}</p></div><div id="comments"><p>- First! {_LONG}</p></div>
    <div id="footer">- All rights reserved {_LONG}</div></body>""",
    f"""<body><div class="topbar">- Sign in</div><div class="post-body"><h2>+ A post</h2><p>+ {_LONG}</p><ol><li>+ step</li><li>+ another step</li></ol>
    </div><div class="related"><h3>- Related</h3><p>- {_LONG}</p></div><div class="newsletter">- Subscribe for more. {_LONG}</div></body>""",
    # text outside the article, and paragraphs of the article that are links
    f"""<body><div>- Ten years of news, every day.</div><article><h1>+ A list of links</h1><p>+ {_LONG}</p><p><a href=/1>+ The first thing</a></p>
    <p><a href=/2>+ The second thing is longer</a></p><ul><li><a href=/3>+ third</a><li><a href=/4>+ fourth</a></ul><p>+ That was all.</p></article>
    <p>- {_LONG}</p><div>- Made somewhere with care.</div><div>- {_LONG} {_LONG}</div></body>""",
    f"""<body><p>- Today it rains.</p><main><h2>+ Sources</h2><p><a href=/1>+ one</a></p><p><a href=/2>+ two</a></p><p>+ {_LONG}</p></main><p>- {_LONG}</p>
    <div><a href=/5>- Terms</a></div></body>""",
    # wrappers that are named like the regions they hold
    f"""<body><div class="layout has-sidebar"><div class="content no-comments"><article><h1>+ A wrapped headline</h1><p>+ {_LONG}</p><p>+ Yes.</p>
    <div class="share">- Share</div><p>+ {_LONG}</p></article><div id="comments"><article class="comment"><p>- {_LONG}</p></article></div></div>
    <div class="sidebar"><p>- {_LONG}</p><a href=/1>- more</a></div></div><footer>- {_LONG}</footer></body>""",
    f"""<body><form id="aspnet"><div>- Site</div><main><h1>+ All of the page is a form</h1><p>+ {_LONG}</p><p>+ So it is.</p><form><label>- Your mail</label>
    </form><aside>- {_LONG}</aside></main><div>- {_LONG}</div></form></body>""",
    # nothing is named: words, links and neighbours decide
    f"""<body><div><a href=/1>- Home</a> <a href=/2>About</a> <a href=/3>Contact</a></div><div><a href=/4>- Archive</a></div><div><h1>+ Plain page</h1>
    <p>+ {_LONG}</p><p>+ {_LONG} {_LONG}</p><p>+ {_LONG}</p></div><div><a href=/5>- Next</a> <a href=/6>Previous</a></div><div>- Copyright</div></body>""",
    f"""<body><p><a href=/1>- Index</a></p><h1>+ Another one</h1><p>+ {_LONG} {_LONG}</p><p>+ {_LONG} <a href=/2>see there</a></p>
    <p><a href=/3>- Back to the top of it</a></p><p><a href=/4>- Print</a></p></body>""",
    f"""<body><div><p>+ {_LONG}</p><p>+ {_LONG}</p></div></body>""",
    f"""<body><p>+ Yes.</p><p>+ {_LONG}</p><p>+ No, not at all.</p><p>+ {_LONG}</p><p>+ So it was.</p><p>+ {_LONG}</p></body>""",
    "+ plain text of a few words",
    f"""<p>+ A line.</p><p>+ {_LONG}</p><p>+ Another line of it.</p><p>+ The last one.</p>""",
    f"""<body><table><tr><td><a href=/1>- One</a><td><a href=/2>- Two</a></table><p>+ {_LONG}</p><p>+ {_LONG}</p><p><a href=/3>- More of this</a></p></body>""",
)


def _words(rng: random.Random, least: int, most: int) -> str:
    return " ".join(rng.choices(_LONG.split(), k=rng.randint(least, most)))


def _links(rng: random.Random) -> str:
    """Blocks that are links: menus, lists of other pages, addresses at the end."""
    tag = rng.choice(["li", "div", "p", "td"])
    return "".join(f"<{tag}><a href=/{k}>- {_words(rng, 1, rng.choice([1, 3, 8]))}</a></{tag}>" for k in range(rng.randint(2, 7)))


def _paragraphs(rng: random.Random, tag: str, most: int = 7) -> str:
    """Long paragraphs with short ones and a link among them."""
    out = [f"<{tag}>+ {_words(rng, 18, 130)}</{tag}>"]
    for _ in range(rng.randint(1, most)):
        kind = rng.random()
        if kind < 0.25:
            out.append(f"<{tag}>+ {_words(rng, 1, 9)}</{tag}>")
        elif kind < 0.4:
            out.append(f"<{tag}>+ {_words(rng, 20, 60)} <a href=/x>{_words(rng, 1, 4)}</a></{tag}>")
        out.append(f"<{tag}>+ {_words(rng, 18, 130)}</{tag}>")
    return "".join(out)


def _unnamed(rng: random.Random) -> str:
    """A page of ``div`` and ``p``: links and short lines around a heading and paragraphs."""
    tag = rng.choice(["p", "div"])
    short = lambda most: f"<div>- {_words(rng, 2, most)}</div>" if rng.random() < 0.6 else ""
    title = f"<h1>+ {_words(rng, 3, 14)}</h1>" if rng.random() < 0.8 else ""
    linked_end = rng.choice(["", _links(rng), f"<div>- {_words(rng, 2, 6)} <a href=/i>{_words(rng, 2, 6)}</a></div>"])
    return f"<body><div>{_links(rng)}</div>{short(12)}<div>{title}{_paragraphs(rng, tag)}</div>{linked_end}{short(14)}</body>"


def _named(rng: random.Random) -> str:
    """A page whose regions are named: what stands in them belongs to them, however long and linked it is."""
    any_ = lambda sign: "".join(
        rng.choice([f"<p>{sign} {_words(rng, 1, rng.choice([4, 15, 90]))}</p>", f"<p><a href=/a>{sign} {_words(rng, 1, 9)}</a></p>", f"<h2>{sign} {_words(rng, 1, 9)}</h2>"])
        for _ in range(rng.randint(2, 8))
    )
    before, after = (rng.choice(["nav", "header", "div class=ad", "div id=sidebar", "aside"]) for _ in range(2))
    main = rng.choice(["article", "main", "div class=content", "div id=post"])
    close = lambda tag: tag.split()[0]
    outside = f"<div>- {_words(rng, 1, 60)}</div>" if rng.random() < 0.5 else ""
    return (
        f"<body><{before}>{any_('-')}</{close(before)}>{outside}<{main}>{any_('+')}</{close(main)}>"
        f"<{after}>{any_('-')}</{close(after)}><footer>{any_('-')}</footer></body>"
    )


def _made(n_unnamed: int = 90, n_named: int = 40, seed: int = 3) -> tuple[str, ...]:
    rng = random.Random(seed)
    return (*(_unnamed(rng) for _ in range(n_unnamed)), *(_named(rng) for _ in range(n_named)))


PAGES = (*_WRITTEN, *_made())
