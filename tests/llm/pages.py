"""Pages written by hand, with their blocks in page order: + before a block of the article, - before any other."""

PAGES = {
    "table, list, code": """<!DOCTYPE html><html lang="en"><head><title>Rivers</title><script>if (a<b && c>d) { document.write("<p>no</p>"); }</script></head><body>
<header class="site-header"><a href="/">Geo Notes</a></header><nav><ul><li><a href="/maps">Maps</a></li><li><a href="/about">About</a></li></ul></nav>
<main><article><h1>Measuring the length of rivers</h1><p>How long a river is depends on where you begin to measure, and on the scale of the map that you use for it.</p>
<table><tr><th>River</th><th>Length</th></tr><tr><td>Danube</td><td>2850 km</td></tr><tr><td>Rhine</td><td>1233 km</td></tr></table>
<p>The steps are these:</p><ol><li>Download the file.</li><li>Find the source that lies farthest from the mouth.</li><li>Add up the distances.</li></ol>
<pre>total = sum(d for d in distances)</pre><dl><dt>mode</dt><dd>Sets the mode.</dd><dt>scale</dt><dd>The scale of the map.</dd></dl></article></main>
<aside class="related"><h3>Related posts</h3><ul><li><a href="/lakes">The largest lakes</a></li></ul></aside><footer><p>Copyright 2021 Geo Notes. All rights reserved.</p></footer></body></html>""",
    "german, ids": """<html><head><title>Brot</title></head><body><div id="kopf"><a href="/">Backstube am Markt</a></div><div id="navi"><a href="/a">Start</a> <a href="/b">Rezepte</a> <a href="/c">Kontakt</a></div>
<div id="inhalt"><h1>Sauerteigbrot ohne Hefe</h1><p>Der Teig braucht vor allem Zeit. Wer ihn am Abend ansetzt, kann am nächsten Morgen backen.</p><h2>Zutaten</h2><ul><li>500 g Roggenmehl</li><li>350 ml Wasser</li><li>Salz</li></ul>
<p>Alles wird gut verrührt und zugedeckt an einen warmen Ort gestellt, bis sich Blasen bilden.</p></div>
<div id="fuss">Impressum | Datenschutz</div></body></html>""",
    "no classes": """<html><body><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/contact">Contact</a></li></ul>
<h1>The old mill reopens</h1><p>After three years of repairs the mill at the edge of the village has opened its doors again.</p><p>Visitors can watch the wheel turn every Sunday between two and five, and buy flour that was ground on the spot.</p>
<p>The repairs were paid for by the county and by more than four hundred private donors.</p><p><small>Copyright 2019 Valley Press</small></p></body></html>""",
    "comments and forms": """<html><body><div class="navbar"><a href="/">Start</a><a href="/x">Archive</a></div><div class="cookie-consent"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
<div class="post"><h1>Why I stopped multitasking</h1><p class="meta">Posted by Jo on May 4</p><div class="entry-content"><p>For years I thought that doing two things at once made me faster. It did not.</p><blockquote>What is done in a hurry is done twice.</blockquote>
<p>So I tried something else: one thing, one hour, no phone. After a week I had finished what had taken a month before.</p></div></div>
<div id="comments"><h3>2 comments</h3><ol><li><p>Thanks, this is what I needed to hear today, I will try it next week at work.</p></li><li><p>I don't agree at all, some people can do it very well.</p></li></ol><form><label>Your name</label><input><textarea></textarea><button>Send</button></form></div>
<div class="footer">Powered by nothing in particular</div></body></html>""",
    "french, adverts": """<html><body><nav class="menu"><a href="/">Accueil</a> <a href="/p">Politique</a></nav><article class="article"><h1>La bibliothèque ferme ses portes</h1><p>Après plus de cent ans, la petite bibliothèque de la rue des Lilas fermera à la fin du mois.</p>
<div class="publicite"><p>Publicité : achetez maintenant !</p></div><p>Les livres seront donnés aux écoles du quartier, a annoncé la mairie.</p><figure><img src="a.jpg"><figcaption>La salle de lecture en 1932</figcaption></figure></article>
<section class="commentaires"><p>Quelle triste nouvelle, j'y allais enfant.</p></section><footer class="pied"><p>Mentions légales</p></footer></body></html>""",
    "documentation": """<html><body><div class="sidebar"><ul><li><a href="#i">Install</a></li><li><a href="#u">Usage</a></li></ul></div><div class="content"><h1>Quick start</h1><h2>Install</h2><p>Unpack the archive and run the script.</p><pre><code>./setup --prefix=/usr/local</code></pre>
<h2>Usage</h2><p>Call the program with the name of a file:</p><pre>prog [options] file</pre><table><tr><td>-v</td><td>say more</td></tr><tr><td>-q</td><td>say less</td></tr></table></div><div class="footer">Version 2.1</div></body></html>""",
    "sections in main": """<body><header><h2>City Weekly</h2><p>News from around the corner</p></header><main><section><h1>New tram line planned</h1><p>The city council wants to build a tram line from the station to the hospital.</p></section><section><h2>What it costs</h2><p>About ninety million, most of which would come from the state.</p></section></main>
<section class="newsletter"><p>Subscribe to our newsletter</p><form><input type="email"></form></section><footer><ul><li>Imprint</li><li>Privacy</li></ul></footer></body>""",
}
#: Words that a block outside the article begins with, page by page; all other blocks are article.
OTHERS = {
    "table, list, code": ["Geo Notes", "Maps", "About", "Related posts", "The largest lakes", "Copyright 2021"],
    "german, ids": ["Backstube", "Start Rezepte", "Impressum"],
    "no classes": ["Home", "News", "Contact", "Copyright 2019"],
    "comments and forms": ["StartArchive", "We use cookies", "Accept", "Posted by", "2 comments", "Thanks, this", "I don't agree", "Your name", "Powered by"],
    "french, adverts": ["Accueil", "Publicité", "Quelle triste", "Mentions"],
    "documentation": ["Install\0", "Usage\0", "Version"],
    "sections in main": ["City Weekly", "News from", "Subscribe", "Imprint", "Privacy"],
}


def marked(name, blocks):
    """Whether each block is article."""
    left = list(OTHERS[name])
    out = []
    for t in blocks:
        hit = next((x for x in left if t.startswith(x.rstrip("\0"))), None)
        if hit:
            left.remove(hit)
        out.append(hit is None)
    assert not left, left
    return out
