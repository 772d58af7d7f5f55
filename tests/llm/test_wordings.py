"""Residue in wordings that come from no table: how much is found, how little is false.

The second set was written after the rules and not used to change them. When the first
set was first tried, 56 of its 67 messages were found and 1 of 45 harmless lines was
marked; general rules were then mended with it in view.
"""

import pytest

from voxloom.llm import residue

FIRST = """\
<<name>>
*|FNAME|*
{!Contact.Name}
%%name%%
Hello <%= @user.first %>, welcome
Dear [[recipient]],
{{#if customer}}Hi{{/if}}
Bonjour ${prenom}, voici votre texte
Hallo @@VORNAME@@, hier ist deine Lektion
Dear {first_name}, here is chapter two
[Insert chapter title here]
[Hier Titel einfügen]
[Titre à compléter]
[Inserte aquí el nombre]
[Insira o seu texto aqui]
[Vul hier uw naam in]
[Buraya adınızı yazın]
[Вставьте имя сюда]
【ここに名前を入力してください】
Please enable JavaScript to view this page. This site relies on scripts to show its stories, so without them nothing can be displayed here; check the settings of your browser and reload the page afterwards, thank you.
Error 503 Service Unavailable. The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later, or contact the administrator of this machine.
The requested URL was not found on this server.
We can't seem to find what you're looking for.
This content is no longer available.
The server encountered an internal error and was unable to complete your request.
Your connection was refused by the host.
The audio file could not be played.
Diese Webseite ist derzeit nicht erreichbar.
Die Verbindung zum Server ist fehlgeschlagen.
Ihre Sitzung wurde beendet, bitte melden Sie sich erneut an.
Der Inhalt konnte leider nicht geladen werden.
Cette adresse n'existe pas sur notre serveur.
Le service est momentanément indisponible, veuillez réessayer.
La connexion au serveur a échoué.
El servidor no responde en este momento.
No hemos podido encontrar la página que buscas.
La conexión ha sido rechazada.
Não conseguimos carregar este conteúdo.
O servidor não responde, tente novamente mais tarde.
Esta ligação expirou.
Deze inhoud is niet meer beschikbaar.
De server reageert niet, probeer het later opnieuw.
Het gevraagde document kan niet worden gevonden.
Aradığınız içerik kaldırılmış olabilir.
Sunucuya ulaşılamıyor, lütfen daha sonra tekrar deneyin.
Bağlantı zaman aşımına uğradı, sayfa yüklenemedi.
Сервер не отвечает, попробуйте позже.
Запрошенный документ был удалён или перемещён.
Не удаётся установить соединение с сервером.
お探しのページは移動または削除された可能性があります。
サーバーに接続できませんでした。
通信エラーが発生しました。もう一度お試しください。
You need to turn on scripts in your browser to use this website.
Diese Seite benötigt Skripte, bitte aktivieren Sie sie.
Ce site nécessite l'activation de JavaScript.
Este sitio web necesita JavaScript para funcionar.
Este site precisa de JavaScript para funcionar.
Voor deze website moet JavaScript zijn ingeschakeld.
Bu siteyi kullanmak için JavaScript'i etkinleştirmeniz gerekir.
Для работы сайта необходимо включить JavaScript.
このサイトではJavaScriptを有効にする必要があります。
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Your text goes here
Hier steht später der eigentliche Text.
Welcome back, undefined!
Total: NaN items
Hello null, your story is ready.
""".splitlines()
FIRST_HARMLESS = """\
404 people not counted came to the fair.
500 metres later they stopped.
The page he was looking for was not found in the old book.
She turned the page and found the missing letter.
The server brought two plates and forgot the soup.
Nobody could open the old file cabinet in the office.
The recording was not good, said the sound engineer.
The host welcomed us and no link was broken between them.
A session of the council ended late in the evening.
They could not find the address on the map.
I could not connect the two stories at first.
The document was signed by the mayor and later moved to the archive.
Die Seite fehlte, und er fand den Brief nicht.
Er konnte die Datei nicht finden und ging nach Hause.
Der Inhalt der Kiste war nicht zu sehen.
La page était blanche et elle ne trouvait plus ses mots.
Il n'existe pas de plus beau document, disait le notaire.
El servidor trajo la sopa y nadie dijo nada.
La página estaba en blanco y ella no encontró sus palabras.
A página estava rasgada e ela não a encontrou.
De pagina was leeg en hij kon zijn bril niet vinden.
De opname begint om acht uur en niemand is te laat.
Sayfayı çevirdi ve mektubu bulamadı.
Kayıt sabah başladı ve kimse konuşmadı.
Он перевернул страницу и не нашёл письма.
Запись началась вечером, и никто не говорил.
彼はページをめくったが、手紙は見つからなかった。
録音は静かな部屋で行われた。
[laughs] She opens the door.
[Anna leaves the stage]
<nar_event type=sob duration=short>
{"pace": "slow", "pitch": 3}
**Important**: read this slowly.
__init__ is a name that every programmer knows.
A sign such as {name} is replaced before the recording.
The word null means nothing in German law.
100% of the 500 guests stayed.
--- chapter two ---
# Chapter 1: The Harbour
In JavaScript, a function may return another function.
The script of the play needs two more pages.
Our host asked us to enable the old radio.
The request was denied by the king, and the knight went home.
Access to the castle was refused for three days.
The connection between both towns was interrupted by snow.
""".splitlines()
SECOND = """\
Sorry, this episode can't be played right now. The stream is offline.
Bad gateway: the upstream host did not respond.
Looks like this link is broken or the page has been removed.
Your download failed. Please check your connection and try again.
Die angeforderte Datei wurde gelöscht.
Der Server ist überlastet, bitte versuchen Sie es in einigen Minuten erneut.
Zugriff auf dieses Dokument wurde verweigert.
Le fichier demandé a été supprimé.
Le serveur ne répond pas, réessayez plus tard.
L'accès à cette page vous est interdit.
Este enlace ha caducado.
El archivo solicitado ya no está disponible.
A página que procura não existe.
Este ficheiro foi removido do servidor.
Uw sessie is verlopen, log opnieuw in.
Deze link werkt niet meer.
Bu sayfaya şu anda erişilemiyor.
İstediğiniz dosya silinmiş.
Эта страница была удалена.
Срок действия ссылки истёк.
このリンクは期限切れです。
指定されたファイルは存在しません。
Scripts must be enabled in your browser before this story can be shown.
Bitte schalten Sie JavaScript ein, um fortzufahren.
Activez JavaScript pour lire cette page.
Active JavaScript para continuar leyendo.
Schakel JavaScript in om verder te lezen.
Devam etmek için JavaScript'i açın.
Включите JavaScript, чтобы читать дальше.
{{ episode.title }}
Hi $FIRST_NAME, this is your lesson.
Chapter %(number)s of %(total)s
#{speaker} opens the door
Good morning, [object Object]!
""".splitlines()
SECOND_HARMLESS = """\
The link between the brothers was never broken.
The server at the inn does not speak English.
A file of soldiers could not be seen from the hill.
We cannot open the window in winter.
Der Server des Gasthauses ist müde und geht nach Hause.
Die Verbindung der beiden Städte ist alt.
Le fichier du notaire est plein de poussière.
La connexion entre les deux villages est lente en hiver.
El archivo de la ciudad abre a las nueve.
La cuenta del hotel no era cara.
A ligação entre as ilhas faz-se de barco.
Het bestand bleef eeuwenlang bewaard in het klooster.
De verbinding met het eiland is in de winter langzaam.
Belge eski bir sandıkta saklanıyor.
Kayıt stüdyosu sabah dokuzda açılır.
Сервер стоит в холодной комнате без окон.
Запись концерта длится два часа.
ファイルは棚の上に置いてある。
接続の駅で電車を待った。
The clerk explains that an error page says the file was not found.
Jo reads: a notice like this asks people to enable JavaScript.
(whispers) Do not open the door.
403 steps lead up to the tower.
The score was 500 to 404 at the end.
A long error in the manuscript was corrected by hand.
""".splitlines()


@pytest.mark.parametrize(("real", "harmless"), [(FIRST, FIRST_HARMLESS), (SECOND, SECOND_HARMLESS)])
def test_recall_and_precision(real, harmless):
    hits, false = sum(bool(residue.line_kinds(x)) for x in real), sum(bool(residue.line_kinds(x)) for x in harmless)
    assert hits >= 0.9 * len(real) and hits >= 0.9 * (hits + false)


def test_length_decides_nothing():
    filler = "Anna walks along the river and nobody speaks, while the boats drift slowly past the old mill. "
    for said in ("The requested URL was not found on this server.", "Error 503 Service Unavailable.", "Please enable JavaScript to view this page.", "Hello undefined, welcome back."):
        assert residue.line_kinds(said) and residue.line_kinds(said + " " + filler * 40) and residue.line_kinds(filler * 40 + said)
    name = "first_name_of_the_reader_who_asked_for_this_text" * 9
    for slot in (f"{{{{ {name} }}}}", f"${{{name}}}", f"<<{name}>>", f"{{{name}}}"):
        assert residue.line_kinds(f"Dear {slot}, welcome.") == {"placeholder"}


def test_weak_signs_need_other_evidence(spark):
    said = "Wochenmarkt\nDer Server und der Browser haben einen Fehler"  # says nothing about the title
    docs = [(i, said, f"source-{i % 3}") for i in range(6)] + [(10, "Wochenmarkt\nAuf dem Wochenmarkt fand der Server keinen Fehler, und die Leute kauften lange Zeit Brot, Obst und Blumen", "source-1")]
    got = {r.doc_id: r for r in residue.detect(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert all(got[i].residue and got[i].kinds == ["host"] and got[i].copies == 6 and got[i].hosts == 3 and got[i].score >= residue.THRESHOLD for i in range(6))
    assert not got[10].residue and got[10].score < residue.THRESHOLD
    long = said + " und noch ein Fehler im Browser" * 300  # as long as one likes
    both = [(i, long, f"source-{i % 2}") for i in range(4)]
    assert all(r.residue for r in residue.detect(spark.createDataFrame(both, "doc_id long, text string, source string")).collect())
