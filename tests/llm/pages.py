"""Pages written by hand in the ways that sites are built, none from the generator; § marks the blocks of main text and is taken off."""

LOREM = "The council met on Tuesday to hear about the new bridge. It will cost four million and open in spring, the mayor said, if the weather holds."
MORE = "Residents asked who would pay for repairs. The engineer pointed to a fund that the county keeps for such cases, and nobody objected."

PAGES = {
    "wordpress": f"""<!DOCTYPE html><html lang="en-US"><head><title>x</title><style>.a{{}}</style></head><body class="post-template-default single single-post postid-12 wp-custom-logo"><div class="wp-site-blocks"><header class="wp-block-template-part site-header"><div class="wp-block-group is-layout-flex"><p class="wp-block-site-title"><a href="/">River News</a></p><nav class="wp-block-navigation"><ul><li class="wp-block-navigation-item"><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav></div></header>
<main class="wp-block-group is-layout-constrained"><div class="wp-block-group alignwide"><h1 class="wp-block-post-title">§A bridge for the valley</h1><div class="entry-content wp-block-post-content has-global-padding is-layout-constrained"><p>§{LOREM}</p><p>§{MORE}</p><h2 class="wp-block-heading">§What comes next</h2><ul class="wp-block-list"><li>§A second hearing in May</li><li>§Work from June on</li></ul><p>§{LOREM}</p></div><div class="sharedaddy"><h3>Share this:</h3><ul><li><a href="#">Tweet</a></li><li><a href="#">Facebook</a></li></ul></div></div>
<div class="wp-block-comments comments-area" id="comments"><h2>2 responses to this post</h2><ol class="comment-list"><li class="comment"><p>Great read, thanks. I think the fund is nearly empty though, as my neighbour told me last week.</p></li><li class="comment"><p>Agreed.</p></li></ol><form id="commentform"><label>Your comment</label><textarea></textarea><p>Your email address will not be published.</p><button>Post comment</button></form></div></main>
<footer class="wp-block-template-part site-footer"><p>Proudly powered by a blog engine.</p><p>© 2021 River News</p></footer></div><script>var a="<p>no</p>";</script></body></html>""",
    "divs": f"""<html><body><div id="wrapper"><div id="header"><div class="logo">Acme Daily</div><div class="slogan">News since 1950</div></div><div id="menu"><a href="/">Front page</a> | <a href="/s">Sport</a> | <a href="/c">Culture</a></div><div id="content"><div class="post"><h2>§Bridge gets the nod</h2><div class="entry"><p>§{LOREM}</p><p>§{MORE}</p><blockquote>§It was about time, said one.</blockquote><p>§{MORE}</p></div></div></div><div id="sidebar"><h3>Recent posts</h3><ul><li><a href="/1">Fair opens</a></li><li><a href="/2">Rain ends drought</a></li></ul><h3>Archives</h3><ul><li><a href="/3">May 2019</a></li></ul></div><div id="footer">Copyright Acme Daily. All rights reserved.</div></div></body></html>""",
    "cookie": f"""<html><body><div class="cookie-banner" role="dialog"><p>We use cookies to make this site work and to measure how it is used. Read our policy.</p><button>Accept all</button><button>Settings</button></div><header><a href="/">Gazette</a><form class="search"><input><button>Search</button></form></header><article><header><h1>§Dry summer ahead</h1><p class="byline">By J. Doe</p></header><section><p>§{LOREM}</p><p>§{MORE}</p></section><aside class="ad"><p>Advertisement: buy two tyres and pay for one. Offer ends on Sunday.</p></aside><section><h2>§Wells run low</h2><p>§{LOREM}</p></section></article><aside class="related"><h2>Related stories</h2><ul><li><a href="/x">Farmers pray for rain</a></li></ul></aside><footer><ul><li><a href="/i">Imprint</a></li><li><a href="/p">Privacy</a></li></ul></footer></body></html>""",
    "docs": f"""<html><body><nav class="navbar"><div class="container"><a href="/">Project</a><ul class="nav"><li><a href="/d">Docs</a></li><li><a href="/b">Blog</a></li></ul></div></nav><div class="container"><div class="row"><div class="col-md-3 toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div><div class="col-md-9" role="main"><h1>§Getting started</h1><p>§{LOREM}</p><h2 id="a">§Install</h2><pre>§make install</pre><p>§{MORE}</p><table><tr><th>§Option</th><th>§Meaning</th></tr><tr><td>§-v</td><td>§Say more</td></tr></table><p>§{LOREM}</p></div></div></div><footer class="footer"><div class="container"><p>Built with a static site generator.</p></div></footer></body></html>""",
    "table layout": f"""<html><body bgcolor=white><table width=100%><tr><td colspan=2><center><font size=6>Bob's Home Page</font></center></td></tr><tr><td class="menu" width=150><a href=a.html>Home</a><br><a href=b.html>Links</a><br><a href=c.html>Guestbook</a></td><td class="content"><h1>§My trip to the lake</h1><p>§{LOREM}<p>§{MORE}<p>§{LOREM}</td></tr><tr><td colspan=2 class="footer"><font size=1>Last updated 1999. Best viewed in any browser.</font></td></tr></table></body></html>""",
    "bare": f"""<html><body><h1>§Notes on bread</h1><p>§{LOREM}</p><p>§{MORE}</p><p>§{LOREM}</p></body></html>""",
    "news deep": f"""<html><body class="page"><div id="app"><div class="layout layout--wide"><div class="layout__top"><div class="topbar topbar--dark"><span>Edition: World</span><a href="/login">Sign in</a></div><nav class="main-nav" aria-label="Main"><ul class="main-nav__list"><li class="main-nav__item"><a href="/w">World</a></li><li class="main-nav__item"><a href="/b">Business</a></li><li class="main-nav__item"><a href="/t">Tech</a></li></ul></nav></div><div class="layout__body grid grid--12"><div class="grid__col grid__col--8"><div class="article article--standard"><div class="article__header"><h1 class="article__title text-xl font-bold">§Bridge plan is passed</h1></div><div class="article__body rich-text"><div class="rich-text__block"><p>§{LOREM}</p></div><div class="rich-text__block"><p>§{MORE}</p></div><div class="newsletter-signup"><h4>Sign up to our morning briefing</h4><p>Enter your email to get the news each day.</p></div><div class="rich-text__block"><p>§{LOREM}</p></div><div class="rich-text__block"><h3>§The cost</h3><p>§{MORE}</p></div></div></div></div><div class="grid__col grid__col--4"><div class="most-read"><h3>Most read</h3><ol><li><a href="/1">Storm warning for the coast</a></li><li><a href="/2">Shares fall again</a></li></ol></div></div></div><div class="layout__bottom"><div class="site-footer"><p>Terms of use apply to this service. Registered in England under number 123.</p></div></div></div></div></body></html>""",
    "forum": f"""<html><body><div class="header"><h1>Garden forum</h1></div><div class="breadcrumbs"><a href="/">Index</a> &raquo; <a href="/v">Vegetables</a></div><div class="content"><div class="post-body"><h2>§How to keep slugs away</h2><p>§{LOREM}</p><p>§{MORE}</p></div></div><div class="comments"><div class="comment"><div class="comment-author">anna wrote 3 days ago:</div><div class="comment-body">I use coffee grounds. They work well enough in a dry week, less so in a wet one.</div></div><div class="comment"><div class="comment-author">ben wrote:</div><div class="comment-body">Beer traps.</div></div></div><div class="footer">Powered by forum software</div></body></html>""",
    "german": f"""<html lang=de><body><header class="kopf"><a href="/">Tagblatt</a></header><nav><ul><li><a href=/a>Startseite</a><li><a href=/b>Politik</a></ul></nav><main><article><h1>§Brücke kommt</h1><p>§Der Rat hat am Dienstag beschlossen, die Brücke zu bauen. Sie kostet vier Millionen, sagte die Bürgermeisterin, und soll im Frühjahr öffnen.</p><p>§Die Anwohner fragten, wer für Schäden aufkommt. Dafür gibt es einen Fonds.</p></article></main><aside><h2>Meistgelesen</h2><ul><li><a href=/1>Regen</a></ul></aside><footer><p>Impressum und Datenschutz. Alle Rechte vorbehalten.</p></footer></body></html>""",
    "footer prose": f"""<html><body><nav><a href=/>Home</a></nav><article><h1>§Rain</h1><p>§{LOREM}</p><p>§{MORE}</p></article><footer><p>{LOREM}</p></footer></body></html>""",
    "aside first": f"""<html><body><aside class="sidebar"><p>{MORE}</p><p>{LOREM}</p></aside><div class="notice"><p>This site needs a newer browser. Some parts may not work as they should.</p></div><main><h1>§Snow</h1><p>§{LOREM}</p><p>§{MORE}</p></main><section class="comments"><h3>Comments</h3><article class="comment"><p>{LOREM}</p></article><article class="comment"><p>First!</p></article></section></body></html>""",
    "nothing": """<html><body><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><form><label>User</label><input><label>Password</label><input><button>Log in</button></form><footer>© Site</footer></body></html>""",
}
