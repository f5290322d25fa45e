"""The labelled table of the HTML extractor: small hand-written pages.

Text that belongs to the main text begins with ``§``, which is removed before
the blocks are measured; every other block is boilerplate.
"""

PAGES = (
    # news page with every kind of frame around the article
    """<html><head><title>News</title></head><body><header><div class="logo">The Daily</div><nav><ul><li><a href="/">Home</a></li>
<li><a href="/w">World news</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies to make this site better. By reading on you accept them and our terms of use.</div>
<main><article><h1>§Harbour reopens after the storm</h1><p class="byline">§By our reporter, Monday</p>
<p>§The harbour opened again on Monday after three days of wind and high water had kept ships away from the quay.</p>
<p>§Short note.</p><p>§Crews had worked through the night to clear the channel, and the first ferry left at dawn with some forty people aboard.</p>
<aside class="related"><h3>Related</h3><p>A long teaser of another story that readers of this article may also like to open and read today.</p><ul><li><a href="/a">Older storm</a></li></ul></aside>
<blockquote>§We were lucky this time, said the harbour master, and thanked all who had helped.</blockquote>
<p>§More in <a href="/x">the full report</a> of the harbour office.</p></article></main>
<div class="ad">Buy one coat and get the second at half the price, only this week in all our shops.</div>
<section class="comments"><h2>Comments</h2><div class="comment">I was there and it was far worse than this story says, the water came over the wall twice.</div>
<div class="comment">Nice.</div></section><footer>&copy; The Daily &middot; All rights reserved by the publisher of this paper. <a href="/i">Imprint</a></footer></body></html>""",
    # blog without article element
    """<body><div id="header"><a href="/">My blog</a></div><div id="menu"><a href="/1">About</a> <a href="/2">Archive</a></div>
<div id="content"><h2>§Baking bread at home</h2><p>§Bread needs flour, water, salt and time; most of the work is waiting for the dough to rise twice.</p>
<ul><li>§Five hundred grams of flour</li><li>§Salt</li></ul><p>§Bake it hot.</p><pre>§mix; wait; bake</pre></div>
<div class="sidebar"><h4>Tags</h4><ul><li><a href="/t">bread</a></li><li><a href="/u">cake</a></li></ul><p>About the writer: somebody who has baked every week for twenty years and writes about it here.</p></div>
<form action="/s"><label>Search this site</label><input name="q"><button>Go</button></form>
<div id="disqus_thread"><p>Great recipe, my family asks for this bread every Sunday now and I bake two.</p></div>
<div id="footer">Powered by a blog engine that many people use for sites like this one.</div></body>""",
    # bare page: no containers at all, links at both ends
    """<body><p><a href="/">Home</a> <a href="/n">News</a> <a href="/c">Contact</a></p>
<h1>§A walk along the river</h1><p>§The path begins behind the mill and follows the river for about six miles to the old bridge, always on the left bank.</p>
<p>§Turn back there.</p><p>§On the way home the sun stands low over the fields, and the inn by the lock serves a plain but good supper to walkers.</p>
<p><a href="/p">Previous walk</a> <a href="/q">Next walk</a></p><p><a href="/m">Site map</a></p></body>""",
    # the same with one long teaser block made of links
    """<body><div><a href="/1">First page</a> | <a href="/2">Second page</a> | <a href="/3">Third page</a></div>
<div>§Glass is made by melting sand with ash and lime in a furnace, and it was known long before anybody wrote down how it was done.</div>
<div>§Colour comes from metals in the melt, iron for green and cobalt for the deep blue that old windows show.</div>
<div><a href="/4">Ten old windows you should see this summer</a> <a href="/5">How to cut glass at home without breaking it</a> <a href="/6">All our stories about glass</a></div></body>""",
    # article with header, footer, form, figure, table and notice inside
    """<body><nav class="top"><a href="/">Start</a><a href="/k">Kitchen</a></nav><article><header><h1>§Soup for six</h1></header>
<div class="share">Share this story with friends</div><p>§Cut the roots small.</p>
<figure><img src="a.png"><figcaption>§The pot on the stove</figcaption></figure>
<table><tr><td>§Carrots</td><td>§Three</td></tr></table><form><p>Join our newsletter and get one recipe every week, free of charge and without adverts.</p><input type="email"></form>
<div class="notice">This page was moved; please change your bookmarks before the end of the year.</div>
<div class="advert-box"><p>Knives that stay sharp for years, now with free delivery to your door.</p></div>
<p>§Boil them for half an hour with salt, then add the beans and wait until they are soft.</p><h2>§Notes</h2><p>§It keeps.</p>
<footer>Filed under soup by the kitchen team, with thanks to all who tried it.</footer></article>
<div class="widget">Most read this week: soup, bread, pies and many more dishes for cold days.</div></body>""",
    # shop-like page with main element and dialogs
    """<body><div role="navigation"><ul><li>Garden</li><li>House</li><li>Workshop and tools</li></ul></div><div class="banner">Sale! Everything must go before the end of this month, in all our houses.</div>
<main><h1>§Garden spade</h1><div><p>§A spade of forged steel with an ash handle.</p><p>§Length 1 m</p></div>
<section id="reviews" class="user-comments"><p>Bought it last spring and dug the whole garden with it, not a scratch so far, would buy again.</p><p>Too heavy</p></section></main>
<div role="dialog">Please log in to put this spade on your list of wishes.</div>
<div class="subscribe-box">Subscribe to our letter about gardens and never miss an offer.</div><div role="contentinfo">Garden House Ltd, all rights reserved</div></body>""",
    # plain framed page with short paragraphs, as generators make it
    """<body><nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">beta</a></li><li><a href="/c">gamma.</a></li></ul></nav><div class="ad">Some words that praise a thing. More words. The end.</div>
<article><h1>§Alpha beta gamma delta that</h1><p><b>§Alpha beta gamma.<br><p>§Alpha.</p><p>§Beta gamma delta, of the alpha and with beta, was the alpha that the delta had for a while.</p><p>§The.</p></article>
<footer>&copy; alpha.example &middot; Beta gamma delta and the alpha is the beta of words.</footer></body>""",
    # forum thread where the first post is the text
    """<body><div class="breadcrumbs"><a href="/">Forum</a> &gt; <a href="/g">Gardens</a></div><div class="post-content"><p>§How deep should I plant tulips in heavy soil, and does sand below them help against rot?</p><p>§Thanks</p></div>
<div class="replies comment-list"><p>Plant them three times as deep as the bulb is high; the sand does help in wet winters, I use it every year.</p></div><div class="pagination">1 2 3 next</div></body>""",
    # bare pages whose frame is short plain lines around the text
    """<body><div>Home</div><div>About us</div><div>Contact</div><div>Log in</div>
<div>§Clouds form where moist air rises and cools, and the small drops that we see are far too light to fall at once.</div>
<div>§Rain begins when the drops have grown by meeting one another, or when ice crystals take up their water high above.</div>
<div>§Snow falls if the air below is cold enough down to the ground, and sleet if it is not.</div><div>Top</div><div>Copyright 2020</div><div>Imprint</div></body>""",
    """<body><table><tr><td>Start</td><td>Shop</td><td>Help</td></tr></table><div>§The mill was built beside the weir in the year of the great flood and ground corn for three parishes.</div>
<div>§It burned twice, and each time the miller built it up again with a larger wheel and thicker walls than before.</div><div>Print</div><div>Send</div><div>Legal</div></body>""",
)
