"""Pages labelled by hand: a block that starts with § is main text. Layouts vary; few containers have telling names."""

PAGES = [
    # A plain old page: table layout, no names at all.
    """<html><body><table><tr><td><a href=/>Home</a> <a href=/a>About us</a></td></tr><tr><td><h1>§The harbour at low tide</h1>
    <p>§For three hours the boats lie on their sides and nobody goes out. The men sit on the wall and mend what the winter left of the nets.</p>
    <p>§When the water comes back it comes quickly, and by noon the quay is empty again.</p></td></tr><tr><td>Copyright 2004</td></tr></table></body></html>""",
    # Page header inside the article, pull quote, related links.
    """<body><div id=w><article><h1>§Slow trains</h1><p>§The night service was never fast. It left at ten and reached the coast at seven, with four stops that nobody used.</p>
    <blockquote><p>§It was the only train on which I ever slept, she said.</p></blockquote><p>§Last spring the company ended it without a word to the towns on the line.</p></article>
    <div class=related><ul><li><a href=1>More on railways</a></li><li><a href=2>Ten great stations</a></li></ul></div></div></body>""",
    # Comments without the word, after the text.
    """<body><main><h2>§How to sharpen a plane iron</h2><p>§Flatten the back first, on the coarse stone, until the scratches run to the edge.</p><ol><li>§Set the guide to twenty-five degrees.</li>
    <li>§Work the bevel until a burr can be felt along its whole width.</li></ol><p>§Then turn it over and take the burr off with one stroke.</p></main><section class=thread><h3>What readers said</h3>
    <div class=comment><b>tom</b><p>Thanks, this worked for me.</p></div><div class=comment><b>ana</b><p>I would use thirty degrees instead.</p></div></section></body>""",
    # Cookie notice first, long menu, form at the end.
    """<body><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div><nav><ul><li><a href=1>News</a></li><li><a href=2>Sport</a></li><li><a href=3>Culture</a></li></ul></nav>
    <div class="post-content"><h1>§Rain at last</h1><p>§After seventy dry days the valley had its first rain on Tuesday, eleven millimetres in one night.</p><p>§Farmers say it is too late for the maize but in time for the grass.</p></div>
    <form action=/s><label>Your address</label><input><button>Subscribe</button></form><footer><p>All rights reserved.</p></footer></body>""",
    # Recipe with lists and a sidebar.
    """<body><header><a href=/>Kitchen</a></header><div class=content><h1>§Lentil soup</h1><p>§A soup for four, ready in forty minutes.</p><ul><li>§200 g brown lentils</li><li>§two carrots, diced</li><li>§one onion</li></ul>
    <p>§Soften the onion, add everything else and cover with water. Simmer until the lentils are done.</p></div><aside><h3>Newsletter</h3><p>One recipe a week in your mailbox.</p></aside></body>""",
    # Definition lists and a table of values in the text.
    """<body><article><h1>§Weights of common timbers</h1><p>§Dry weights in kilograms per cubic metre.</p><table><tr><th>§Wood</th><th>§Weight</th></tr><tr><td>§Oak</td><td>§720</td></tr><tr><td>§Spruce</td><td>§430</td></tr></table>
    <dl><dt>§Dry</dt><dd>§Stored at twelve per cent moisture for a year.</dd></dl></article><footer><a href=/i>Imprint</a></footer></body>""",
    # Advert in the middle of the text, share bar above.
    """<body><div class=share><a href=1>Share</a> <a href=2>Print</a></div><article><h1>§The last lamplighter</h1><p>§He started at fifteen and walked eleven kilometres every evening, with a ladder on his shoulder.</p>
    <div class="ad"><p>Buy two lamps and pay for one.</p></div><p>§In the end there were nine lamps left, all in one street, and he lit them for the tourists.</p></article></body>""",
    # Forum-like: heading and one long post.
    """<body><div class=nav><a href=1>Forum</a> &gt; <a href=2>Gardens</a></div><div class=entry><h2>§Moss between the stones</h2><p>§Does anyone leave it in? Ours has grown for ten years and the path looks better than ever, even if it is slippery in autumn.</p>
    <p>§We only take it out on the steps.</p></div><div class=footer><p>Powered by an old machine.</p></div></body>""",
    # Broken markup.
    """<body><nav><a href=1>Start<a href=2>Map</nav><article><h1>§Two bridges<p>§The old one is for walkers only since the flood.<p>§The new one was built in eleven weeks and carries everything else.</article><footer>Contact""",
    # Another script, page header in the article.
    """<body><article><header><div class=logo>城市报</div></header><h1>§河边的老市场</h1><p>§每天早上五点，卖鱼的人就来了。他们在河边摆摊已经三十年了。</p><p>§市场明年要搬到城外。</p></article><footer><p>版权所有</p></footer></body>""",
    # Login box and breadcrumb before a long text.
    """<body><div class=breadcrumbs><a href=1>Home</a> / <a href=2>History</a></div><form class=login><input name=u><button>Log in</button></form><main><h1>§A short history of salt</h1>
    <p>§Towns grew where it was found and roads were built to carry it. Whoever held the passes could tax it, and did.</p><h2>§The mines</h2><p>§Below the mountain the galleries run for seventeen kilometres.</p>
    <h2>§The pans</h2><p>§On the coast it took nothing but wind, sun and patience.</p></main></body>""",
    # Popup and promo blocks around a notice of one paragraph.
    """<body><div class="modal popup"><p>Only today: half price.</p><button>Close</button></div><section class=story><h1>§Library closed on Friday</h1><p>§The reading room stays closed on Friday because the heating is being replaced. Books can be returned at the side door.</p></section>
    <div class=promo><a href=1>Our shop</a></div></body>""",
]
