"""Main text of pages: named cases, and random pages against a plain version of the steps."""

import math
import random
import re

from plexmer.llm import html_text
from plexmer.llm.html_text import main_text

long = lambda w, n: " ".join([w] * n)
MENU = "<div><ul><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>About us</a></ul></div>"
POST = f"<h1>Title</h1><p>{long('one', 60)}</p><p>Ok.</p><p>{long('two', 80)}</p>"
TEXT = "\n".join(["Title", long("one", 60), "Ok.", long("two", 80)])


def test_wrappers_keep_their_article():
    for open_ in ('<div id="page" class="site with-sidebar">', '<div class="post comments-open">', '<div id="search-guide">', "<form id=aspnetForm>", '<div role="dialog">'):
        close = "</form>" if open_.startswith("<form") else "</div>"
        for post, end in ((POST, ""), (f"<article>{POST}</article>", ""), (POST, '<div class="sidebar"><p>See also this</p></div>')):
            assert main_text(f"<body>{open_}{MENU}{post}{end}{close}<div>(c) us</div></body>") == TEXT, open_


def test_minor_blocks_go():
    ad = f"<div class=ad>{long('buy', 200)}</div>"
    comments = f"<div id=comments><p>{long('nice', 300)}</p></div>"
    for page in (f"{ad}<article>{POST}</article>{comments}", f"<main>{POST}</main>{ad}", f"<div>{POST}</div><div class=cookie-notice>{long('ok', 15)}</div>", f"<div>{POST}</div><aside><p>{long('more', 30)}</p></aside><nav>{long('x', 500)}</nav>"):
        assert main_text(f"<html><body>{MENU}{page}<footer>{long('legal', 40)}</footer></body></html>") == TEXT


def test_plain_pages_follow_the_ratios(monkeypatch):
    foot = "<div><a href=/x>Imprint</a> <a href=/y>Contact</a></div>"
    rng, changed = random.Random(1), 0
    pages = []
    for _ in range(50):
        parts = [f"<p>{long(rng.choice('abc'), rng.randint(40, 120))}</p>" for _ in range(rng.randint(1, 6))]
        pages.append((f"<body>{MENU}<div>{''.join(parts)}</div>{foot}</body>", "\n".join(re.sub("<.*?>", "", p) for p in parts)))
    assert all(main_text(page) == text for page, text in pages)
    monkeypatch.setattr(html_text, "in_clusters", lambda ratios, f=html_text.in_clusters: f(ratios * 0 + 1))
    changed = sum(main_text(page) != text for page, text in pages)
    assert changed >= 45  # without ratios the menus come along


def test_silence_ends_with_its_element():
    rest = f"<p>{long('rest', 50)}</p>"
    for bad in ("<p>Start <object><param name=x></p>", "<ul><li>Start <video src=x><li>item</ul>", "<div>Start <svg><g></div>"):
        assert long("rest", 50) in main_text(f"<body><article>{bad}{rest}{rest}</article></body>")


def test_odd_pages():
    assert main_text("<script>" * 3) == "" and main_text("<div>" * 9000 + "deep" + "</div>" * 9000) == "deep"
    big = "".join(f"<p>{i} {long('word', 30)}</p>" for i in range(20_000))
    assert main_text(f"<article>{big}</article>").count("\n") == 19_999


def plain(tree):
    """The steps of the module on a tree of (tag, name, children or text), without its parser or arrays."""
    lines, tags = [], 0

    def walk(node, above):
        nonlocal tags
        tag, name, inner = node
        tags += 1
        chain = [*above, node]
        if isinstance(inner, str):
            lines.append({"text": inner, "tags": tags + 1, "chain": chain})
            tags = 0
            return
        for child in inner:
            walk(child, chain)
        tags += 1

    walk(tree, [])
    if not lines:
        return ""
    ratio = [len(x["text"]) / x["tags"] for x in lines]
    near = []
    for i in range(len(ratio)):
        weight = {j: math.exp(-0.5 * (j - i) ** 2) for j in range(len(ratio)) if abs(j - i) <= 3}
        near.append(sum(w * ratio[j] for j, w in weight.items()) / sum(weight.values()))
    mid = sum(ratio) / len(ratio)
    spread = math.sqrt(sum((x - mid) ** 2 for x in ratio) / len(ratio))
    region = lambda x: next((e for e in x["chain"] if e[0] in ("article", "main")), None)
    never = lambda x: any(e[0] in ("nav", "footer") for e in x["chain"])
    for x, r, own in zip(lines, near, ratio):
        x["content"] = min(r, own) >= 0.5 * spread - 1e-9
    cluster = [x for x in lines if x["content"] and not never(x)]
    total = sum(len(x["text"]) for x in cluster)

    marked = lambda e: e[0] == "aside" or e[1] in ("ad", "comments", "sidebar")
    has = lambda chain, e: any(z is e for z in chain)

    def minor(x):
        for depth, e in enumerate(x["chain"]):
            if marked(e):
                below = [y for y in cluster if has(y["chain"], e)]
                elsewhere = any(region(y) and not never(y) and not has(y["chain"], e) and all(has(x["chain"][:depth], z) for z in y["chain"] if marked(z)) for y in lines)
                if sum(len(y["text"]) for y in below) < 0.9 * total or elsewhere:
                    return True
        return False

    left = [x for x in lines if not never(x) and not minor(x)]
    if not any(x["content"] for x in left):
        for x in left:
            x["content"] = True
    content = [x for x in left if x["content"]]
    regions = [region(x) for x in content if region(x)]
    if sum(len(x["text"]) for x in content if region(x)) >= 0.5 * sum(len(x["text"]) for x in content):
        return "\n".join(x["text"] for x in left if any(region(x) is r for r in regions))
    at = [i for i, x in enumerate(left) if x["content"]]
    low, high = at[0], at[-1]
    while low and left[low - 1]["chain"][-1][0] == "h2":
        low -= 1
    beside = [x["chain"][-2] for x in content if x["chain"][-1][0] in ("p", "h2")] + [e for x in content for e in x["chain"][1:-1]]
    keep = [x["content"] or low <= i <= high or x["chain"][-1][0] in ("p", "h2") and any(x["chain"][-2] is b for b in beside) for i, x in enumerate(left)]
    return "\n".join(x["text"] for x, k in zip(left, keep) if k)


def test_random_pages_against_a_plain_version():
    rng = random.Random(11)
    number = iter(range(10**9))

    def node(depth):
        if depth == 0 or rng.random() < 0.3:
            return (rng.choice(("p", "p", "p", "div", "h2")), "", f"t{next(number)} " + long("w", rng.choice((1, 3, 10, 40, 120))))
        tag = rng.choice(("div", "div", "section", "article", "aside", "nav", "main", "footer"))
        name = rng.choice(("", "", "", "ad", "comments", "sidebar")) if tag in ("div", "section") else ""
        return (tag, name, [node(depth - 1) for _ in range(rng.randint(0, 4))])

    def html(x):
        tag, name, inner = x
        return f"<{tag} class='{name}'>" + (inner if isinstance(inner, str) else "".join(map(html, inner))) + f"</{tag}>"

    kinds = set()
    for _ in range(3000):
        tree = ("body", "", [node(4) for _ in range(rng.randint(1, 4))])
        want = plain(tree)
        assert main_text(html(tree)) == want, html(tree)
        kinds.add(min(3, want.count("\n")))
    assert len(kinds) == 4
