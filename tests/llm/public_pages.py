"""Pages in public markup, labelled by hand: a page, and its article's blocks."""

TEXTS = (
    "The river rose by two metres in a single night, and the town moved its market to the hill.",
    "Nobody had seen water that high since the old mill was built, according to the harbour master.",
    "By noon the ferries ran again, though the lower quay stayed closed until the end of the week.",
)
SAID = ("I was there and it was much worse than this article says, honestly.", "Great write-up, thanks for sharing it with all of us here!", "You are wrong. The old mill was rebuilt twice. Check your facts before you post.")
TITLE = "High water in the old town"
BODY = "".join(f"<p>{t}</p>" for t in TEXTS)
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/about">About us</a></li><li><a href="/contact">Contact</a></li></ul>'


def page(body):
    return f"<!DOCTYPE html><html><head><title>{TITLE} - The Gazette</title></head><body>{body}</body></html>"


WORDPRESS = "".join(
    f'<li id="comment-{k}" class="comment even thread-even depth-1"><article id="div-comment-{k}" class="comment-body"><footer class="comment-meta"><div class="comment-author vcard"><b class="fn">Reader {k}</b> <span class="says">says:</span></div>'
    f'<div class="comment-metadata"><a href="#c{k}"><time>May {k}, 2021 at 9:0{k} am</time></a></div></footer><div class="comment-content"><p>{t}</p></div><div class="reply"><a href="#r">Reply</a></div></article></li>'
    for k, t in enumerate(SAID, 1)
)
FORM = '<div id="respond" class="comment-respond"><h3 id="reply-title">Leave a reply</h3><form><p class="comment-notes">Your address will not be published.</p><label>Comment</label><textarea></textarea><button>Post comment</button></form></div>'
PLAIN = "".join(f"<li><p>{t}</p></li>" for t in SAID)
HEAD = f'<header id="masthead" class="site-header"><h1 class="site-title"><a href="/">The Gazette</a></h1><p class="site-description">News from the valley</p></header><nav class="main-navigation">{NAV}</nav>'
FOOT = '<footer class="site-footer"><p>&copy; 2021 The Gazette. All rights reserved.</p></footer>'

PAGES = {
    "blog": page(f'{HEAD}<main id="main"><article class="post hentry"><header class="entry-header"><h1 class="entry-title">{TITLE}</h1><div class="entry-meta">Posted on <time>May 1</time> by <a href="/a">Ann Li</a></div></header><div class="entry-content">{BODY}</div></article><div id="comments" class="comments-area"><h2 class="comments-title">3 thoughts</h2><ol class="comment-list">{WORDPRESS}</ol>{FORM}</div></main>{FOOT}'),
    "blog, plain list": page(f'{HEAD}<article><h1>{TITLE}</h1>{BODY}</article><section id="comments"><h3>Comments</h3><ul>{PLAIN}</ul></section>{FOOT}'),
    "blog, ordered": page(f'<div id="header"><a href="/">The Gazette</a></div><div id="content"><h2>{TITLE}</h2>{BODY}</div><div class="comments"><ol class="commentlist">{PLAIN}</ol></div><div id="footer">Powered by words</div>'),
    "news": page(f'<div class="topbar">{NAV}</div><main><article class="story"><h1 class="headline">{TITLE}</h1><div class="byline">By Ann Li | 3 May 2021</div><div class="story-body">{BODY}</div><div class="share"><a href="#">Share</a> <a href="#">Post</a></div></article><aside class="sidebar"><h3>Most read</h3>{NAV}</aside></main><section class="reader-comments"><h2>Reader comments</h2>'
                 + "".join(f'<div class="comment"><div class="comment-author">Reader</div><p>{t}</p></div>' for t in SAID) + f"</section>{FOOT}"),
    "news, discussion": page(f'<nav>{NAV}</nav><article><h1>{TITLE}</h1>{BODY}</article><div class="discussion">' + "".join(f'<article class="comment"><header>Reader, 3 May</header><p>{t}</p></article>' for t in SAID) + f"</div>{FOOT}"),
    "hosted comments": page(f'<nav>{NAV}</nav><main><h1>{TITLE}</h1>{BODY}</main><div id="disqus_thread"><ul class="post-list">' + "".join(f'<li class="post"><div class="post-content"><span class="author">Reader</span><div class="post-message"><p>{t}</p></div></div></li>' for t in SAID) + f"</ul></div>{FOOT}"),
    "terms": page(f'<div class="menu">{NAV}</div><div class="content"><h1>{TITLE}</h1>{BODY}</div><div id="comments"><dl>' + "".join(f"<dt>Reader wrote</dt><dd><p>{t}</p></dd>" for t in SAID) + f"</dl></div>{FOOT}"),
    "table": page(f'<div class="menu">{NAV}</div><div class="content"><h1>{TITLE}</h1>{BODY}</div><div class="comments"><table>' + "".join(f"<tr><td>Reader</td><td>{t}</td></tr>" for t in SAID) + f"</table></div>{FOOT}"),
    "nested replies": page(f'<article><h1>{TITLE}</h1>{BODY}</article><section class="comments"><ol><li class="comment"><div class="comment-body"><p>{SAID[0]}</p></div><ol class="children"><li class="comment"><div class="comment-body"><p>{SAID[1]}</p></div><ol class="children"><li class="comment"><div class="comment-body"><p>{SAID[2]}</p></div></li></ol></li></ol></li></ol></section>'),
    "responses": page(f'<header class="banner">{NAV}</header><article class="post"><h1>{TITLE}</h1>{BODY}</article><div class="responses"><h3>Responses</h3>' + "".join(f'<div class="response"><p>{t}</p><div class="actions"><a href="#">Reply</a> <a href="#">Like</a></div></div>' for t in SAID) + "</div>"),
    "feedback": page(f'<div id="nav">{NAV}</div><div id="article"><h1>{TITLE}</h1>{BODY}</div><div id="feedback"><p>Feedback</p>' + "".join(f"<blockquote>{t}</blockquote>" for t in SAID) + "</div>"),
    "comments without a frame": page(f'<nav>{NAV}</nav><article><h1>{TITLE}</h1>{BODY}</article><h2 id="comments">Comments</h2><ul class="comments">' + "".join(f'<li class="comment">{t}</li>' for t in SAID) + f"</ul>{FOOT}"),
    "cookies": page(f'<div class="cookie-banner"><p>We use cookies to give you the best experience. Accept all?</p><button>Accept</button></div><main><article><h1>{TITLE}</h1>{BODY}</article></main>{FOOT}'),
    "advert inside": page(f'<nav>{NAV}</nav><article><h1>{TITLE}</h1><p>{TEXTS[0]}</p><div class="advert">Buy two tickets and travel with a friend for free.</div><p>{TEXTS[1]}</p><p>{TEXTS[2]}</p></article>{FOOT}'),
    "newsletter": page(f'<main class="content"><h1>{TITLE}</h1>{BODY}</main><form class="newsletter"><label>Get our letter every week</label><input><button>Subscribe</button></form>{FOOT}'),
    "wiki": page(f'<div id="content"><h1 id="firstHeading">{TITLE}</h1><div id="bodyContent">{BODY}</div></div><div id="mw-navigation"><h2>Navigation menu</h2>{NAV}</div><div id="footer"><ul><li>Text is available under a free license.</li></ul></div>'),
    "forum": page(f'<div class="breadcrumbs"><a href="/">Board</a> <a href="/f">Forum</a></div><main><article><h1>{TITLE}</h1>{BODY}</article></main><div class="replies">' + "".join(f'<div class="reply"><div class="author">Member</div><div class="reply-text">{t}</div></div>' for t in SAID) + f"</div>{FOOT}"),
    "site header": page(f'<header><div class="logo"><a href="/">The Gazette</a></div><p class="tagline">News from the valley</p><nav>{NAV}</nav></header><article><h1>{TITLE}</h1>{BODY}</article>'),
    "no names": page(f'<div class="x1"><a href="/">A</a> <a href="/b">B</a></div><div class="q7"><h1>{TITLE}</h1>{BODY}</div><div class="z3"><a href="/c">C</a> <a href="/d">D</a></div>'),
    "no names, nested": page(f'<div class="k"><div class="x1"><ul><li><a href="/">Alpha</a></li><li><a href="/b">Beta</a></li></ul></div><div class="l"><div class="q7"><h1>{TITLE}</h1>{BODY}</div></div></div><div class="z3">&copy; 2021</div>'),
    "table layout": page(f'<table><tr><td><a href="/">Alpha</a></td><td><a href="/b">Beta</a></td></tr></table><table><tr><td><h1>{TITLE}</h1>{BODY}</td></tr></table>'),
    "bare": page(f"<h1>{TITLE}</h1>{BODY}"),
}
