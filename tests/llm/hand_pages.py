"""Pages labelled by hand, laid out otherwise than the grammar the field is trained on: (html, blocks of main text)."""

PAGES = [
    ("""<!doctype html><html><head><title>Bread</title><link rel=stylesheet href=x.css></head><body id=top><div class=topbar><a href=/>Home</a> <a href=/r>Recipes</a></div>
<main><h1>Plain white bread</h1><p>This loaf needs no starter and is ready in three hours.</p><h2>Ingredients</h2><ol><li>500 g flour</li><li>300 ml water</li><li>Salt</li></ol>
<h2>Steps</h2><ol><li>Mix the dough and let it rest for an hour.</li><li>Bake until the crust is brown.</li></ol></main>
<div class=sidebar><h3>Popular</h3><ul><li><a href=1>Rye bread</a></li><li><a href=2>Rolls</a></li></ul></div><footer><p>&copy; 2021 Bakers</p></footer></body></html>""",
     ["Plain white bread", "This loaf needs no starter and is ready in three hours.", "Ingredients", "500 g flour", "300 ml water", "Salt", "Steps",
      "Mix the dough and let it rest for an hour.", "Bake until the crust is brown."]),
    ("""<body><div><div><p>Nested divs without classes hold this text that goes on.</p><p>A second paragraph follows it and is about as long as the first.</p></div></div><div>(c) 2020 Someone</div></body>""",
     ["Nested divs without classes hold this text that goes on.", "A second paragraph follows it and is about as long as the first."]),
    ("""<article><header><h1>Markets close higher</h1></header><section id="share-prices"><h2>Share prices</h2><p>Share prices rose on Monday after two weeks of losses.</p></section>
<section id="outlook"><p>Analysts expect the trend to hold until the end of the month.</p></section></article><section class="comments"><h3>Comments</h3><p>I do not believe any of this, sorry.</p></section>""",
     ["Markets close higher", "Share prices", "Share prices rose on Monday after two weeks of losses.", "Analysts expect the trend to hold until the end of the month."]),
    ("""<html><body><header class="masthead"><nav><a href="/">Start</a><a href="/about">About us</a></nav></header><div id="page"><div class="post-body"><h1>A walk in the hills</h1>
<figure><img src="h.jpg"><figcaption>The view from the second summit in the early morning.</figcaption></figure><p>We left the village before sunrise and met nobody for hours.</p>
<blockquote>Take water with you, said the farmer.</blockquote><p>He was right.</p></div></div><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>OK</button></div>
<footer><ul><li><a href="/imprint">Imprint</a></li></ul></footer></body></html>""",
     ["A walk in the hills", "The view from the second summit in the early morning.", "We left the village before sunrise and met nobody for hours.",
      "Take water with you, said the farmer.", "He was right."]),
    ("""<body><form action=/s class=searchbox><label>Search</label><input name=q></form><div class=glossary><h1>Terms of the trade</h1><dl><dt>Ledger</dt><dd>A book in which amounts are kept by account.</dd>
<dt>Journal</dt><dd>A book in which amounts are kept by day.</dd></dl></div><div class=footer>Copyright 2019, all rights reserved.</div></body>""",
     ["Terms of the trade", "Ledger", "A book in which amounts are kept by account.", "Journal", "A book in which amounts are kept by day."]),
    ("""<table width=100%><tr><td class=nav><a href=a>Index</a><br><a href=b>Next</a></td><td><h2>Chapter four</h2><p>The ship lay at anchor for nine days while the crew mended the sails.</p>
<p>On the tenth day the wind turned, and nobody spoke of the storm again.</p></td></tr></table>""",
     ["Chapter four", "The ship lay at anchor for nine days while the crew mended the sails.", "On the tenth day the wind turned, and nobody spoke of the storm again."]),
    ("""<body><div class="site-notice">Maintenance on Sunday.</div><article class="entry"><h1>How we moved the database</h1><p>The move took a weekend. These are the steps that we took.</p><pre>stop writers
copy files</pre><p>Nothing was lost, and the old server is off now.</p><aside class="related-posts"><h4>Read next</h4><ul><li><a href=1>Backups</a></li></ul></aside></article></body>""",
     ["How we moved the database", "The move took a weekend. These are the steps that we took.", "stop writers copy files", "Nothing was lost, and the old server is off now."]),
    ("""<div id=content><h1>Wetter</h1><p>Am Wochenende wird es kühler, sagt der Dienst, und im Norden regnet es.</p><p>Ab Montag scheint wieder die Sonne.</p></div><div id=footer><a href=/impressum>Impressum</a></div>""",
     ["Wetter", "Am Wochenende wird es kühler, sagt der Dienst, und im Norden regnet es.", "Ab Montag scheint wieder die Sonne."]),
    ("""<body><ul class="menu"><li><a href=1>News</a></li><li><a href=2>Sports</a></li><li><a href=3>Weather</a></li></ul><section><h1>Council votes on bridge</h1><p>The council voted last night to repair the old bridge at the mill.</p>
<div class="advertisement"><p>Buy two, get one free, only this week!</p></div><p>Work begins in spring and will take about a year, the mayor said.</p></section><form class="newsletter"><p>Get our letter every week.</p></form></body>""",
     ["Council votes on bridge", "The council voted last night to repair the old bridge at the mill.", "Work begins in spring and will take about a year, the mayor said."]),
    ("""<html><body><main role=main><article><h1>Notice periods explained</h1><div class="notice-period"><p>The notice period is four weeks, unless the contract says otherwise.</p></div><div class="menu-of-the-week"><p>This part of the handbook is about the canteen and its menu.</p></div>
</article></main><div class="social share"><a href=x>Share</a> <a href=y>Post</a></div><div class="comment-list"><p class="comment">Thanks, this helped me a lot with my own letter.</p></div></body></html>""",
     ["Notice periods explained", "The notice period is four weeks, unless the contract says otherwise.", "This part of the handbook is about the canteen and its menu."]),
    ("""<body><nav class="breadcrumb"><a href=/>Home</a> / <a href=/g>Guides</a></nav><h1>Planting garlic</h1><p>Garlic is planted in autumn, a hand apart.</p><ul><li><p>Choose large cloves, as small ones give small bulbs.</p></li><li><p>Press them in with the tip up.</p></li></ul><hr><p><small>© Garden club</small></p></body>""",
     ["Planting garlic", "Garlic is planted in autumn, a hand apart.", "Choose large cloves, as small ones give small bulbs.", "Press them in with the tip up."]),
    ("""<div class="login-form"><form><p>User name</p><p>Password</p></form></div><noscript>Please turn on scripts.</noscript>""", []),
]
