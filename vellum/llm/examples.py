"""The labelled table of ``htmltext``: small pages of many layouts.

A text block that belongs to a page's article begins with ``KEEP``.
"""

KEEP = "+"

PAGES = (
    # Semantic elements, menu, advert, footer; paragraphs left open.
    """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li><li><a href="/c">Sports and games</a></li></ul></nav>
<div class="ad">Buy the best shoes in town now. Only this week for half the price.</div><article><h1>+Heavy rain floods three villages</h1>
<p>+The river left its banks on Monday night after two days of heavy rain, and three villages had to be evacuated in the dark.<p>+Nobody was hurt.<p>+Firefighters pumped water out of cellars until the morning, and the road to the coast is still closed.<br>More rain is expected.</article>
<footer>&copy; 2021 example.org &middot; All words are made up here.</footer></body></html>""",
    # One line of text only, between furniture.
    """<body><nav><a href="/">Start</a> <a href="/x">News</a></nav><div class="ad-banner">Win a trip around the world today and take your friends with you.</div>
<article><h1>+Short news</h1><p>+The shop opens at nine.</p></article><footer>&copy; shop.example &middot; We are glad that you came to see us again today.</footer></body>""",
    # Header and main, sidebar with text, comments with whole sentences.
    """<body><header><a href="/">The Daily</a><p>News for everyone since long ago.</p></header><main><h1>+Council votes for new bridge</h1>
<p>+After a debate of six hours the council voted for a new bridge over the river, which will be open to trams and bicycles alone.</p>
<h2>+What it costs</h2><p>+Forty million, <a href="/c">says the mayor</a>, half of it paid by the state.</p><ul><li>+Ten million for the ramps</li><li>+Thirty million for the bridge</li></ul>
<blockquote>+It will change how we move.</blockquote></main>
<aside><h3>Most read</h3><p>Our readers like this week's long report about the new harbour, the people who work there and the ships that no longer come.</p></aside>
<section class="comments"><h3>3 comments</h3><div class="comment"><p>I do not believe that this bridge will ever be built, the council has promised it for as long as I have lived here.</p></div>
<div class="comment"><p>Great news!</p></div><div class="comment"><p>Who pays for it in the end? We do, as always, and the trams will be as full as before.</p></div></section>
<footer><p>The Daily is made by people who live here. Write to us whenever you want, we answer each letter.</p></footer></body>""",
    # Dialogs and notices before the article, forms behind it.
    """<body><div id="cookie-notice"><p>We use cookies to make this site better for you. By reading on you agree to our use of them as set out in the policy.</p><button>Accept</button></div>
<div class="notice">This site will be closed for some hours on Sunday night while we move it to a new home.</div>
<article class="post"><h1>+How to mend a bicycle tube</h1><p>+Take the wheel out, press the tyre from the rim and pull the tube out with care. Then look for the hole under water.</p>
<p>+Rough up the place.</p><p>+Spread the glue thinly and wait five minutes before you press the patch on; most people do not wait long enough, and the patch comes off.</p>
<div class="share"><a href="#">Share</a> <a href="#">Send</a> this page to a friend who has a flat tyre too</div></article>
<form><label>Your name</label><p>Subscribe to our letter and get one new repair every week, free of charge and of adverts.</p><input name="a"></form></body>""",
    # No semantic elements and no telling classes: only words and links tell.
    """<body><table><tr><td><a href="/1">First</a></td><td><a href="/2">Second</a></td><td><a href="/3">Third</a></td></tr></table>
<div><h1>+The old mill</h1><div>+The mill stands where two brooks meet and has ground corn for four hundred years, most of the time for the same family.</div>
<div>+Today nobody grinds corn there any more, but the wheel still turns, and on Sundays visitors can see the stones at work and buy bread.</div>
<div>+The roof was mended last year.</div><div>+A path leads from the station along the brook to the mill, a walk of half an hour through meadows and woods that is nice at all times of the year.</div></div>
<div><a href="/4">About</a></div><div><a href="/5">Contact us</a></div><div><a href="/6">All pages of this site</a></div></body>""",
    """<body><div><div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/t">Travel</a> | <a href="/f">Food and drink</a></div></div>
<div><p>+Bread needs four things, flour, water, salt and time, and of these time is the one that most bakers today will no longer give it.</p>
<p>+So we let ours rest for a night, in a cool room, and bake it at four in the morning, when the street is still dark and quiet.</p><p>+Come and try.</p></div>
<div><a href="/a">Ten soups for cold days</a></div><div><a href="/b">Why salt is not just salt</a></div><div><a href="/c">A visit to the market hall</a></div></body>""",
    """<body><div class="wrap"><div class="menu"><ul><li><a href="/">Home</a></li><li>Here</li></ul></div><div class="content"><h2>+Notes of May</h2><p>+Planted beans.</p><p>+Rain.</p>
<p>+The bees came out early this year, and the first swarm hung in the plum tree before I had the new hive painted.</p></div>
<div class="sidebar-left"><h4>About me</h4><p>I keep bees and a garden at the edge of a small town and write down what happens there.</p></div>
<div class="related-posts"><h4>Related</h4><a href="/1">Notes of April, with snow</a> <a href="/2">Notes of March</a></div><div class="footer-text">All pictures are mine, ask me before you use them for yourself.</div></div></body>""",
    # Header and footer within the article, figure, table, preformatted text, links in text.
    """<body><div role="navigation"><a href="/d">Docs</a><a href="/b">Blog</a></div><div role="main"><article><header class="entry-header"><h1>+Sorting files by date</h1><p>+By the team, 4 May</p></header>
<p>+Sorting is easy with <a href="/ls">this tool</a> and <a href="/sort">that one</a>, as both read dates.</p><pre>+list --by date</pre><table><tr><th>+Option</th><th>+Meaning</th></tr><tr><td>+by</td><td>+what to sort by</td></tr></table>
<figure><img src="x.png"><figcaption>+The list after sorting</figcaption></figure><p>+See also <a href="/x">the long list of all the options</a>.</p><footer>Filed under files and dates by the team</footer></article></div>
<div role="complementary"><p>You can have this page as a book, printed on paper and sent to your home within some days.</p></div></body>""",
    # Adverts and teasers amid the paragraphs.
    """<body><div class="topbar"><span>Monday, 4 May</span></div><article><h1>+A ship comes home</h1><p>+Ninety years after she was built the ship came back to the harbour where her keel was laid, drawn by two tugs and cheered by thousands on the quay.</p>
<div class="advertisement"><p>Sail with us to the islands of the north, seven days on board with all meals and a cabin with a window.</p></div>
<p>+She will be a museum.</p><div class="promo"><p>Read more of this kind: each week we send a letter with the best stories from the coast.</p></div>
<p>+Until then her hull must be mended, the masts be set again and the cabins be cleared of what seventy years of work at sea have left in them.</p><p>+It takes long.</p></article>
<div class="newsletter"><p>Do you like what you read? Leave us your address and we will write to you now and then, no more than once a week.</p></div>
<div id="disqus_thread"><p>I sailed on her as a boy of sixteen and cannot wait to see the masts again, thank you all for the work.</p><p>Me too!</p></div>
<footer>Made with care in a small room by the sea, where the gulls cry all day.</footer></body>""",
    # A listing that is no article.
    """<body><nav><a href="/">Start</a></nav><ul><li><a href="/1">Old maps of the town and its walls</a></li><li><a href="/2">Letters of a miller</a></li><li><a href="/3">The flood in pictures</a></li></ul>
<div class="pager"><a href="?p=2">Next page</a></div><footer>Town archive</footer></body>""",
    # Long article with short paragraphs.
    """<body><nav><ul><li><a href="/w">Weather</a></li><li><a href="/s">Sport</a></li></ul></nav><article><h1>+Final</h1><p>+It was over in a minute.</p><p>+Yes.</p><p>+The cup goes to the guests.</p><p>+Nobody had thought that the guests would win, least of all the guests themselves, who had lost their last four games away from home.</p><p>+Why?</p></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>What a game, I have not seen a better one for years, and I have seen them all since I was a child.</p></article><article class="comment"><p>Lucky.</p></article></section>
<footer>Results come without guarantee.</footer></body>""",
    # Words of furniture as words of the text; wrappers that deny what they name.
    """<body class="has-sidebar no-ads"><div class="site-header"><p>A site about gardens and what grows in them all year</p></div><main class="with-sidebar"><article class="no-comments"><h1>+Menu of the week</h1><p>+Soup on Monday, fish on Friday, and a notice at the door says what there is on the other days.</p>
<p>+Cookies are for sale.</p><h2>+Comments of a cook</h2><p>+He likes it.</p></article></main><div class="cookie-bar">This site keeps small files on your device, as nearly all sites do today.</div>
<div class="widget"><h3>Seeds</h3><p>Order seeds for spring now, we send them in March when the ground is soft enough.</p></div></body>""",
    # Plain page without furniture.
    """<body><h1>+Letter</h1><p>+Dear friends, it has been a long time since I wrote to you, and much has happened in the house and in the garden.</p><p>+More soon.</p></body>""",
    """<p>+The lake lies high in the hills and freezes early; in most years one can walk across it by the middle of December and until the end of March.</p><p>+Take care.</p>""",
    # Nothing behind the article.
    """<body><nav><a href="/">Start</a></nav><article><h1>+Closed</h1><p>+The office is closed today.</p></article></body>""",
    """<body><article><h1>+Lost cat</h1><p>+Grey, shy, answers to no name; last seen near the mill on Sunday.</p></article></body>""",
    """<body><nav><a href="/">Start</a> <a href="/q">Questions</a></nav><article><h1>+Quiz</h1><p>+Which is it?</p><p>+Both.</p></article></body>""",
    """<body><h1>+Recipe</h1><p>+Fry it.</p></body>""",
    """<body><h2>+Note</h2><p>+Back at noon, please leave parcels with the neighbours on the first floor.</p></body>""",
    """<article><p>+One line.</p><p>+Another.</p></article>""",
    """<body><nav><a href="/">Start</a></nav><article><p>+It rains.</p></article></body>""",
    """<body><div><a href="/">Home</a> <a href="/m">Maps</a></div><main><p>+The bridge was opened in spring and is closed again.</p></main></body>""",
    # Short lines around a text without telling elements.
    """<body><div><a href="/">Home</a></div><div>+The tower has two hundred steps, and from the top one sees the whole valley down to where the rivers meet, on clear days even the snow.</div><div>+Open all year.</div><div><a href="/a">Back</a></div><div><a href="/b">Top</a></div></body>""",
    """<body><div><a href="/">Home</a></div><div><a href="/m">Maps</a></div><div>+How to get there: take the train to the end of the line and walk along the dam, always with the water on your left.</div><div>+Or swim.</div><div><a href="/t">Timetables of trains and boats</a></div></body>""",
    # Short words between links, without telling elements.
    """<body><div><a href="/1">Home</a></div><div>You are here</div><div><a href="/2">News</a></div><div>Monday</div><div><a href="/3">Log in</a></div><div>+Two men were found asleep on the roof of the theatre on Sunday morning, after the door had closed behind them in the night.</div>
<div>+They had looked at the stars.</div><div>+The manager brought them down with a ladder and gave them tea, and the theatre now has a bell at the door of the roof.</div><div><a href="/4">More news</a></div><div>Town paper</div><div><a href="/5">About us</a></div><div>All rights reserved</div><div><a href="/6">Terms</a></div></body>""",
    """<body><p><a href="/">Shop</a></p><p>Cart: 0 items</p><p><a href="/l">Lists</a></p><p>+A good knife is kept dry, hangs free and is never put into a drawer with spoons, for what makes it blunt is other steel.</p><p>+Whet it on a wet stone, ten strokes on each side, always with the edge ahead and at the angle that the smith gave to it.</p>
<p><a href="/k">Knives</a></p><p>from 20 on</p><p><a href="/s">Stones</a></p><p>from 9 on</p><p><a href="/o">Oil</a></p></body>""",
    """<body><div><a href="/a">Archive</a></div><div>Search</div><div><a href="/b">Index</a></div><div>+The register of the year names forty houses, of which eleven stood empty after the plague, and it lists the owners by trade.</div><div>+Nine were weavers.</div>
<div>+In the next register, twenty years on, each house has an owner again, and there are twice as many weavers as before.</div><div><a href="/p">Page before</a></div><div>12 of 80</div><div><a href="/n">Next page</a></div></body>""",
    # Links around short articles.
    """<body><article><p>+One line.</p></article><nav><a href="/">Start</a></nav></body>""",
    """<body><nav><a href="/">Start</a></nav><main><h1>+Open</h1></main><footer><a href="/c">Contact</a></footer></body>""",
    """<body><article><h1>+Found</h1><p>+A key.</p></article><aside><a href="/l">Lost things</a></aside></body>""",
)
