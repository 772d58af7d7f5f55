"""Template residue, filler, error pages and script notices in place of content.

Every piece of evidence adds to one score; a document whose score reaches ``THRESHOLD``
holds residue. Placeholders are found by a grammar of mirrored brackets and signs, other
residue by detectors for single lines and the sentences in them. What only looks like a
message (a weak sign) doesn't suffice alone: it counts together with the mismatch between
slug (the source's name), title (the first line) and body, with how much of the text such
signs make up, and with how many documents and hosts (the sources) serve the same text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _parser

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.plans.scale import skew_join, written

#: A text that is served as often, by as many sources, is boilerplate of a host.
COPIES, HOSTS = 3, 2
#: What the pieces of evidence add; the sum that makes residue. Evidence of a line is
#: enough by itself; a weak sign needs all that speaks for it.
STRONG, WEAK, MISMATCH, DENSE, SERVED, THRESHOLD = 1.0, 0.3, 0.2, 0.2, 0.4, 1.0
#: Share of a text's words that signs of a message make up where they are dense.
DENSITY = 0.1

_I = re.IGNORECASE
_TAG = re.compile(r"<nar_(?:control|event)\b[^<>]*>", _I)
_PREFIX = re.compile(r"^(?:>\s*|[-*•]\s+|#{1,6}\s+|\d\d:\d\d(?::\d\d)?\s+)+")

# Placeholders: signs and brackets, what is named, the same signs and brackets mirrored.
_NO, _NOT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_MIRROR = str.maketrans("{[<(", "}]>)")
_SLOT = re.compile(r"(?P<open>[{\[<%$#@|*~!&=?^:-]*[{\[<%$@|#~][{\[<%$#@|*~!&=?^:-]*)[ \t]*(?P<name>[^\W\d][\w.:\- \t|'\"(),/]*?|/?[^\W\d]\w*)[ \t]*(?P<close>[}\]>%$#@|*~!&=?^:-]+)")
_SHORT_SLOT = re.compile(
    rf"\{{\{{[^{{}}\n]*\}}\}}|\{{%[^%\n]*%\}}|<%[^%\n]*%>|<\?(?:=|php\b)[^?\n]*\?>|&lt;%[^%\n]*%&gt;|%\([a-z_][\w.]*\)[sdf]|{_NO}__[A-Z][A-Z0-9_]+__{_NOT}|{_NO}%[A-Z][A-Z0-9_]{{2,}}%|{_NO}\$[A-Z][A-Z0-9_]{{2,}}\$?{_NOT}"
    rf"|(?<![A-Za-z0-9_{{$#!%@])\{{(?:\d{{1,2}}|[a-z_][\w.]*)\}}(?!\}})|(?<![A-Za-z0-9_%])%[sd]{_NOT}"
)


def _slots(line: str) -> Iterator[re.Match]:
    """Placeholders: an opening of two or more signs, at least one bracket or sign of a
    template language among them, and its mirror image at the end (signs may be left
    out there); or a shorter form that template languages share."""
    yield from _SHORT_SLOT.finditer(line)
    for m in _SLOT.finditer(line):
        opens, closes = m["open"], m["close"]
        mirrored = opens[::-1].translate(_MIRROR)
        brackets = [c for c in mirrored if c in "}]>)"]
        if len(opens) < 2 or len(set(opens)) == 1 and opens[0] in "~#=-*:<|" and not (opens in ("<<", "||", "~~", "##") and (opens == "<<" or m["name"].isupper())):
            continue  # emphasis and rules of markdown
        if opens.startswith("<!") or opens[-1] == "<" and len(opens) > 2:
            continue  # comments of markup
        if closes.startswith(mirrored) or brackets and closes.startswith("".join(brackets)) and set(opens) - set("{[<("):
            yield m


# Bracketed instructions: brackets around words that ask for something to be put in.
_ASK = (
    r"insert|your|here|enter|fill|replace|placeholder|add|title here|tbd|todo|einfügen|eintragen|hier|ihr(?:e|en)?|platzhalter|buraya|girin|yazın|ekleyin|"
    r"nom d[ue]|titre d[ue]|insérer|insérez|votre|ici|à compléter|insertar|inserte|su |tu |aquí|nombre d|título d|inserir|insira|seu |sua |aqui|nome d|"
    r"invoegen|vul|uw |jouw|naam van|titel van|вставить|вставьте|ваш|здесь|имя |название|ここに|入力|挿入"
)
_BRACKET = re.compile(r"[\[<【]\s*(?P<in>[^\[\]<>【】\n]{2,}?)\s*[\]>】]")
_ASKS = re.compile(rf"(?:^|\W)(?:{_ASK})", _I)
# Values that failed to render.
_OBJECT = re.compile(r"\[object \w+\]|#(?:REF|NAME|VALUE|DIV/0|N/A)[!?]?|<(?:null|undefined|no value)>", _I)
_VALUE = re.compile(r"(?<![A-Za-zÀ-ɏЀ-ӿ0-9_'’-])(?:null|None|NULL|undefined|NaN|nil|NoneType)(?![A-Za-zÀ-ɏЀ-ӿ0-9_'’-])")
#: Words before or after a placeholder or value that is only talked about.
_LIKE = (
    r"such as|like|called|named|says|said|word|mark|sign|value|token|type|wie|namens|wort|wert|zeichen|comme|mot|repère|valeur|marque|como|palabra|valor|marca|sinal|palavra|"
    r"zoals|als|woord|teken|waarde|вроде|типа|слово|знак|значение|как|gibi|kelimesi|işareti|değeri"
)
_BEFORE = re.compile(rf"(?:^|\W)(?:{_LIKE})\s*[\"'“”«„‘`]*\s*$", _I)
_AFTER = re.compile(r"^\s*[\"'“”»’`]*\s*(?:gibi|kelimesi|işareti|değeri|(?:の|と)よう|という|といった|などの|のごとき)", _I)

# Filler.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum nibh urna felis massa risus lacus turpis augue "
    "mattis porta vitae ligula ornare congue vestibulum pellentesque mauris vivamus integer nunc sapien tortor vel leo orci justo".split()
)
_LATIN_SURE = frozenset("lorem ipsum amet consectetur adipiscing nibh urna felis massa risus lacus turpis augue mattis porta vitae ligula ornare congue tempor quis velit nulla magna sed dolor".split())
_FILLER = (
    r"your \w+ (?:goes )?here|sample text|dummy (?:text|line|copy)|placeholder (?:text|copy|line)|filler (?:copy|line)|placeholder text|text goes here|your text here|content goes here|test text|filler text|some text here|insert text here|to be written|coming soon|"
    "blindtext|platzhaltertext|beispieltext|mustertext|hier steht text|hier steht ihr text|deneme metni|deneme yazısı|örnek metin|buraya metin gelecek|metin buraya|"
    "texte d'exemple|texte de remplissage|faux texte|texte ici|votre texte ici|texto de ejemplo|texto de relleno|texto de prueba|texto simulado|su texto aquí|"
    "texto de exemplo|texto de teste|texto de preenchimento|seu texto aqui|voorbeeldtekst|opvultekst|tekst komt hier|hier komt tekst|hier komt de tekst|testtekst|"
    r"пример текста|текст-заполнитель|рыба[- ]?текст|рыбный текст|тестовый текст|здесь будет текст|текст для примера|ここに本文が入ります|仮テキスト|ここにテキスト|ダミーテキスト|サンプルテキスト|サンプル文章|テキストが入ります|(?:asdf|qwer)\w{0,6}(?: (?:asdf|qwer|zxcv)\w{0,6})*"
)
_FILL = re.compile(rf"(?:{_FILLER})", _I)

# Error messages.
_REASON = r"(?:not found|forbidden|gone|bad gateway|bad request|unauthorized|internal server error|service unavailable|gateway time-?out|too many requests|method not allowed|request time-?out|conflict|payment required)\b"
_STATUS = re.compile(
    r"(?:(?:http|https|error|erreur|fehler|hata|erro|fout|ошибка|エラー|status|code|http error|hata kodu)[\s:/#.-]*)+\(?[45]\d\d\)?(?:\b|(?=[^\w]))(?:[\s:–—|-]+.*)?$|\(?[45]\d\d\)?(?:\s*[:–—|-]+\s.*)?$|"
    rf"[45]\d\d\s+{_REASON}|(?:http|https|error)?[\s:/#.-]*[45]\d\d\s+{_REASON}",
    _I,
)
#: A number and words: a status only with a word of failing.
_NUMBERED = re.compile(r"\(?[45]\d\d\)?\s+\S.*$")
_TRACE = re.compile(
    r"\s*(?:Traceback \(most recent|File \"[^\"]+\", line \d+|at [\w$.<>]+ ?\([^)]*:\d+(?::\d+)?\)|[A-Z]\w*(?:Error|Exception)\b\s*[:(]|(?:Fatal error|Parse error|Warning|Notice|Deprecated|Uncaught\b.*?)\s*:\s.*(?:line \d+|undefined|variable|exception)"
    r"|\w* ?error: (?:no value|missing|unknown|unexpected|cannot|failed|invalid|could not)|panic: |Segmentation fault|java\.lang\.|SQLSTATE\[|ORA-\d{5}|Caused by: )"
)
#: Tried at the beginning of a line only.
_FAILED = re.compile(
    # page, file or recording not found
    r"(?:sorry,? |oops!? ?|we'?re sorry,? )?(?:the |this )?(?:page|file|recording|resource|document|url|link|content)\b[^.!?]{0,50}\b(?:not (?:be )?found|no longer (?:here|available|exists?)|does ?n[o']t exist|unavailable|has (?:been )?(?:moved|expired|removed))"
    r"|(?:aradığınız|istediğiniz|bu) (?:sayfa|dosya|kayıt|içerik)\w* (?:bulunamadı|bulunamıyor|mevcut değil|yüklenemedi|kaldırıl)"
    r"|(?:die |diese |der |das )?(?:angeforderte |gesuchte |gewünschte )?(?:seite|datei|aufnahme|inhalt)\b[^.!?]{0,40}\b(?:nicht gefunden|nicht (?:mehr )?(?:verfügbar|vorhanden|gibt)|konnte nicht|existiert nicht|nicht geladen)"
    r"|(?:die |diese )?seite,? die sie suchen\b|(?:la |cette )?(?:page|fichier|enregistrement)\b[^.!?]{0,40}\b(?:introuvable|n'(?:a pas été trouvée?|existe (?:pas|plus)|est plus (?:là|disponible)))"
    r"|(?:no se ha encontrado|no se encontró|no se encuentra) (?:la|el) (?:página|archivo|grabación)|la página (?:solicitada|que busca)\b|a página (?:solicitada|que procura|pedida)\b|página não encontrada|página no encontrada"
    r"|(?:de )?(?:gevraagde |opgevraagde )?(?:pagina|opname|bestand)\b[^.!?]{0,40}\b(?:niet gevonden|niet (?:meer )?(?:beschikbaar|bestaat)|bestaat niet|kon niet)|deze pagina bestaat niet"
    r"|(?:запрашиваемая |запрошенная |эта )?(?:страница|запись|файл)\b[^.!?]{0,30}(?:не найден|не существует|недоступн|удал[её]н)|страница не найдена|(?:お探しの|この|指定された)?(?:ページ|ファイル|録音)[はが]?.{0,12}(?:見つかりません|存在しません|読み込め)"
    # something went wrong
    r"|(?:oops|something went wrong|an? (?:unexpected |internal |unknown )?(?:server )?error (?:has )?occurred|there (?:was|has been) an? (?:\w+ )?(?:error|problem)|we (?:could not|couldn'?t|are unable to|were unable to|cannot)|unable to (?:load|connect|open|play)|could not (?:load|connect|open|play)|(?:connection|request|session) (?:timed out|refused|failed)|internal server error|service (?:temporarily )?unavailable|bad gateway|access denied|permission denied|page not found|file not found)"
    r"|(?:sunucu\w*\s(?:bir\s)?hata|bir (?:şeyler ters gitti|hata oluştu|hata meydana geldi|sorun oluştu)|beklenmeyen bir hata)|(?:kayıt|sayfa|dosya|içerik) (?:yüklenemedi|açılamadı|bulunamadı)"
    r"|(?:etwas ist schief|(?:es|auf dem server) ist ein (?:\w+ )?fehler aufgetreten|(?:auf dem server|beim laden)\b[^.]{0,30}\bfehler|interner serverfehler|serverfehler|die aufnahme konnte nicht|diese aufnahme konnte nicht|(?:die|diese) \w+ (?:konnte|kann) nicht geladen)"
    r"|(?:une erreur (?:est survenue|s'est produite|inattendue|interne)|un problème est survenu|erreur (?:interne|du serveur|serveur)|impossible de (?:charger|lire|ouvrir)|l'enregistrement n'a pas pu|cet enregistrement n'a pas pu|quelque chose s'est mal)"
    r"|(?:se ha producido un error|ha ocurrido un error|ocurrió un error|hubo un (?:error|problema)|algo (?:salió|ha ido) mal|no se (?:pudo|ha podido) (?:cargar|abrir|reproducir)|error (?:interno|del servidor))"
    r"|(?:ocorreu um (?:erro|problema)|algo deu errado|houve um (?:erro|problema)|não foi possível (?:carregar|abrir|reproduzir)|erro (?:interno|no servidor|do servidor))"
    r"|(?:er is (?:een fout|iets misgegaan|iets fout)|er ging iets (?:mis|fout)|(?:de |deze )?opname kon niet|(?:de|het) \w+ kan niet worden geladen|interne serverfout|we konden)"
    r"|(?:произошла (?:\w+ )?ошибка|на сервере произошла|что-то пошло не так|не удалось (?:загрузить|открыть|воспроизвести)|внутренняя ошибка|ошибка сервера)"
    # session, permission, rate
    r"|(?:your )?session (?:has )?(?:expired|run out|timed out|ended)|you (?:(?:do not|don'?t) have|have no) (?:the )?(?:permission|access)|you are not (?:authori[sz]ed|allowed)|too many requests|please (?:log|sign) in (?:again|to)|(?:rate|request) limit"
    r"|oturum\w* (?:süresi|zaman)|bu (?:dosyaya|sayfaya|içeriğe) (?:erişim|erişme)|erişim (?:reddedildi|engellendi)|çok fazla istek|(?:ihre|deine) (?:sitzung|anmeldung)|sitzung abgelaufen|sie haben keine? (?:berechtigung|zugriff|zugang)|(?:sie sind nicht|zugriff verweigert|kein zugriff)|zu viele anfragen"
    r"|(?:votre|la) session (?:a expiré|est expirée)|vous n'avez pas (?:l'autorisation|la permission|accès|le droit)|accès (?:refusé|interdit)|trop de requêtes|(?:su|la|tu) sesión ha (?:caducado|expirado|terminado)|no tiene(?:s)? (?:permiso|acceso)|acceso denegado|demasiadas (?:solicitudes|peticiones)"
    r"|(?:a )?sua sessão (?:expirou|terminou)|sessão expirada|(?:você )?não tem (?:permissão|acesso)|acesso negado|(?:muitas|demasiados) (?:solicitações|pedidos)|(?:uw|je|jouw) sessie is (?:verlopen|beëindigd)|(?:u|je) hebt? geen (?:toestemming|toegang|rechten)|toegang geweigerd|te veel (?:verzoeken|aanvragen)"
    r"|(?:ваш сеанс|ваша сессия|срок (?:действия )?(?:вашей сессии|сеанса)|время (?:вашей сессии|сеанса)|сессия|сеанс) ?\w* ?(?:ист[её]к|заверш|окончен)|у вас нет (?:доступа|прав|разрешения)|доступ (?:запрещ[её]н|закрыт)|слишком много запросов|(?:セッション|このファイル|このページ).{0,14}(?:切れ|権限|許可|アクセス)|リクエストが多すぎ",
    _I,
)
_FAILED_END = re.compile(
    r"sunucuda bir (?:hata|sorun) (?:oluştu|meydana)|(?:hata oluştu|yüklenemedi)[.!]?$|(?:エラーが発生しました|読み込めませんでした|読み込みに失敗|問題が発生しました|見つかりませんでした|アクセスが拒否|権限がありません|期限が切れました|有効期限)[。.!！]?$",
    _I,
)
# General form of a message, in any wording: what a page or server has, and that it fails,
# in the vocabulary of web pages (not of any table); nobody tells it and nobody else acts in it.
_THING = re.compile(
    r"\b(?:web ?)?(?:page|site|server|file|url|uri|link|resource|document|content|request|connection|session|account|recording|audio|video|player|browser|address|gateway|service|application|database|login|download|stream|host)s?\b"
    r"|\b(?:web)?(?:seite|server|datei|adresse|link|dokument|inhalte?|anfrage|verbindung|sitzung|konto|aufnahme|wiedergabe|browser|dienst|anwendung|datenbank|anmeldung|zugriff)\b"
    r"|\b(?:page|site|serveur|fichier|adresse|lien|document|contenu|requête|demande|connexion|session|compte|enregistrement|lecteur|navigateur|service|application|accès)\b"
    r"|\b(?:página|sitio|servidor|archivo|fichero|enlace|documento|contenido|solicitud|petición|conexión|sesión|cuenta|grabación|reproductor|navegador|servicio|aplicación|acceso|url)\b"
    r"|\b(?:página|site|sítio|servidor|arquivo|ficheiro|endereço|ligação|documento|conteúdo|pedido|solicitação|conexão|sessão|conta|gravação|leitor|navegador|serviço|aplicação|acesso)\b"
    r"|\b(?:web)?(?:pagina|site|server|bestand|adres|document|inhoud|verzoek|aanvraag|verbinding|sessie|account|opname|speler|browser|dienst|toepassing|toegang)\b"
    r"|\b(?:web )?(?:sayfa|site|sunucu|dosya|adres|bağlantı|belge|içerik|içeri[ğk]|istek|(?:isteğ)|oturum|hesap|hesab|kayı[td]|oynatıcı|tarayıcı|hizmet|uygulama|erişim)\w*"
    r"|\b(?:веб-)?(?:страниц|сайт|сервер|файл|адрес|ссылк|документ|содержим|контент|запрос|соединени|подключени|связ[ьи]|сесси|сеанс|аккаунт|учетн|(?:учётн)|запис|плеер|браузер|служб|сервис|приложени|доступ)\w*"
    r"|\b(?:what you(?:['’]re| are) looking for|was sie suchen|ce que vous cherchez|lo que busca\w*|o que procura|wat (?:u|je) zoekt|aradığınız|вы ищете)\b"
    r"|ページ|サイト|サーバー?|ファイル|URL|リンク|コンテンツ|リクエスト|接続|通信|セッション|アカウント|録音|プレーヤー|ブラウザ|サービス|アプリ|アクセス",
    _I,
)
_FAILS = re.compile(
    r"\b(?:not (?:be )?(?:found|reached|loaded|opened|displayed|played|completed|processed|available|authori[sz]ed|allowed|permitted|responding)|(?:can'?t|cannot|can not|could ?n[o']t|couldn['’]t|unable to|failed to) (?:seem to )?(?:be )?(?:find|found|reach|reached|load|loaded|open|opened|display|displayed|play|played|connect|complete|completed|process|processed|establish|established|access|accessed)|unavailable|unreachable|no longer (?:available|exists?|here|valid|supported)|do(?:es)? ?n[o']t exist|(?:has|have) (?:been )?(?:expired|moved|removed|deleted|ended|timed out)|timed out|(?:access|permission|connection|request) (?:is |was |has been )?(?:denied|refused|rejected|blocked)|went wrong|overloaded|too many requests|internal (?:server )?error|under maintenance|offline)\b"
    r"|\b(?:nicht (?:mehr |länger |möglich |)(?:gefunden|finden|geladen|laden|geöffnet|erreichbar|erreicht|verfügbar|vorhanden|abgespielt|angezeigt|antwortet|verarbeitet|möglich|autorisiert|berechtigt|gestattet)|existiert nicht|gibt es nicht|(?:ist|wurde) (?:abgelaufen|gelöscht|entfernt|verschoben|unterbrochen|verweigert|abgelehnt|überlastet)|abgelaufen|verweigert|fehlgeschlagen|schiefgelaufen|schiefgegangen|fehler aufgetreten|wartungsarbeiten)\b"
    r"|\b(?:introuvable|indisponible|inaccessible|injoignable|n['’](?:existe|est)(?: pas|(?: plus))|n['’](?:a|ont) pas (?:pu|été)|a expiré|est expirée?|a été (?:supprimée?|déplacée?|refusée?|interrompue?)|refusée?|interdite?|a échoué|ne répond (?:pas|plus)|est survenue?|s['’]est produite?|surchargé|en maintenance|impossible d)"
    r"|\b(?:no (?:se |le |lo |la )?(?:ha |han |pudo |puede |pudimos |podemos |hemos podido |ha podido )?(?:encontr\w+|cargar\w*|carga\w*|abrir\w*|existe\w*|disponible|responde|reproduc\w+|conectar\w*|acceder|encuentra\w*|está disponible|está autorizado)|ha (?:caducado|expirado|fallado|sido (?:eliminad[oa]|movid[oa]|denegad[oa]|rechazad[oa]))|denegad[oa]|rechazad[oa]|se ha producido|salió mal|ha ido mal|sobrecargado|en mantenimiento|demasiad[oa]s (?:solicitudes|peticiones))\b"
    r"|\b(?:não (?:foi |foram |pôde ser |pode ser |conseguimos |é possível |está |se encontra )?(?:encontrad[oa]|encontrar|carregad[oa]|carregar|abert[oa]|abrir|existe|disponível|responde|possível|ligar|conectar|autorizad[oa])|expirou|terminou|foi (?:removid[oa]|movid[oa]|negad[oa]|recusad[oa]|eliminad[oa])|negad[oa]|recusad[oa]|indisponível|inacessível|ocorreu um|correu mal|deu errado|sobrecarregado|em manutenção|demasiados pedidos|muitas solicitações)\b"
    r"|\b(?:(?:reageert|werkt) (?:\w+ )?niet|niet (?:meer |langer |worden |)(?:gevonden|vinden|geladen|laden|bereikbaar|bereikt|beschikbaar|geopend|afgespeeld|weergegeven|gemachtigd|toegestaan|mogelijk|reageert)|bestaat niet|(?:is|was|werd) (?:verlopen|verwijderd|verplaatst|geweigerd|verbroken|overbelast)|verlopen|geweigerd|misgegaan|fout opgetreden|onderhoud|mislukt)\b"
    r"|(?:bulunama\w+|bulunmuyor|yüklenem\w+|açılam\w+|ulaşılam\w+|erişilem\w+|oynatılam\w+|görüntülenem\w+|kullanılam\w+|mevcut değil|yanıt vermiyor|sona erdi|doldu\b|süresi dol\w+|reddedildi|engellendi|kaldırıl\w+|silin\w+|taşın\w+|(?:hata|sorun) oluştu|başarısız|ters gitti|bakımda|kesildi)"
    r"|(?:не (?:был[аои]? |)(?:найден\w*|удалось|удается|(?:удаётся)|существует|отвечает|доступ\w*|загру\w+|открыва\w+|можем|может быть)|недоступ\w+|(?:истек|(?:истёк))\w*|запрещ\w+|отклон\w+|удал[её]н\w*|перемещ[её]н\w*|прерван\w*|произошл\w+ (?:\w+ )?(?:ошибка|сбой)|перегружен\w*|обслуживани\w+|заверш[её]н\w*)"
    r"|(?:見つかりません|見つかりませんでした|存在しません|読み込めません|開けません|再生できません|表示できません|接続できません|利用できません|ご利用いただけません|応答がありません|応答しません|拒否されました|切れました|切れています|期限切れ|失敗しました|発生しました|許可されていません|メンテナンス中|移動または削除|削除され)",
    _I,
)
#: Somebody acts or owns: a story. Pages speak to the reader or of themselves.
_SOMEBODY = re.compile(
    r"\b(?:he|she|his|her|hers|him|they|them|their|i|me|my)\b|\b(?:er(?! (?:is|was|zijn|wordt|werd|kan|ging|heeft|trad)\b)|ihn|ihm|sein(?:e|en|er|em|es)?|ich|mein(?:e|en|er|em|es)?|mir|mich)\b|\b(?:il avait|elle avait|elles?|ils|lui|leurs?)\b|\b(?:él|ella|ellos|ellas|yo|mi|mis|nadie)\b|\b(?:ele|ela|eles|elas|dele|dela|eu|meu|minha|ninguém)\b"
    r"|\b(?:hij|haar|hun|ik|mijn|niemand)\b|\b(?:onun|ona|onlar|kimse|ben|benim)\b|\b(?:он|она|они|его|е[её]|их|я|мой|моя|мне|никто)\b|彼女?[はがのを]|私[はがのを]|\b(?:nobody|niemand|personne)\b",
    _I,
)
#: Where a message may begin: an interjection, an article or the like, adjectives, then the thing; or the failing itself.
_INTRO = r"(?:[\W_]|\b(?:sorry|oops|ups|hoppla|oups|vaya|hups|üzgünüz|maalesef|leider|désolés?|hélas|lo sentimos|lamentamos|helaas|desculpe|извините|к сожалению|申し訳ありませんが|申し訳ございません|error|erreur|fehler|erro|fout|hata|ошибка|エラー|http|warning|notice)\b|[45]\d\d\b)*"
_LEADS = re.compile(
    _INTRO
    + r"(?:(?:the|this|that|your|an?|die|der|das|diese[rs]?|ihre?|deine?|ein|eine|la|le|les|l['’]|cette?|votre|ce|el|los|las|esta|este|su|tu|una?|o|a|os|as|esta|este|sua|seu|uma?|de|het|deze|dit|uw|je|een|bu|эта|этот|это|ваш[аеу]?|данн\w+|この|お探しの|指定された|ご指定の)\s*)?(?:[\w'’-]+\s+){0,2}?(?:"
    + _THING.pattern
    + ")",
    _I,
)
_IMPERSONAL = re.compile(_INTRO + "(?:" + _FAILS.pattern + ")", _I)
_YOU = re.compile(
    r"\b(?:you|your|we|we're|wir|sie|ihre?r?|vous|votre|nous|usted|ustedes|podemos|pudimos|hemos|você|vocês|conseguimos|u|uw|je|wij?|вы|ваш\w*|вам|мы|нам|siz\w*|aradığınız|istediğiniz|lütfen|please|bitte|por favor|veuillez|alstublieft|пожалуйста|ください|try again|erneut|réessayez|inténtelo|tente novamente|probeer|tekrar deneyin|повторите|попробуйте|もう一度)\b|ください|もう一度|お探しの|ご指定",
    _I,
)


#: Who did it: a story, unless it is the machine.
_AGENT = re.compile(r"\bby (?:the|an?) (?!server|host|site|owner|administrator|author|user|browser|page|system|network|proxy|firewall)\w+", _I)


def _general(sentence: str) -> float:
    """How much a sentence has the form of a message of a page: ``STRONG`` where the
    thing that fails or the failing leads it, or the reader is spoken to; ``WEAK`` where
    it only holds both."""
    if not (_FAILS.search(sentence) and _THING.search(sentence)) or _SOMEBODY.search(sentence) or _AGENT.search(sentence):
        return 0.0
    return STRONG if _LEADS.match(sentence) or _IMPERSONAL.match(sentence) or _YOU.search(sentence) else WEAK


_NUMBER = re.compile(r"^(?:ref(?:erence)?\.?|request id|incident|trace|error code|id|code)?[\s:#.(]*\d{5,}\)?$", _I)
# Notices that scripts are required: an instruction or complaint of the page itself.
_SCRIPT = re.compile(r"javascript|\bscripts?\b|betik|skript|スクリプト|скрипт|\bcookies?\b|\bçerez", _I)
_TURN_ON = re.compile(
    r"\b(?:please (?:enable|allow|turn on|activate)|(?:enable|turn on|activate|allow|switch on)\b.{0,20}\b(?:javascript|scripts?|cookies)|(?:javascript|scripts?|cookies) (?:is|are|must be|needs? to be) (?:required|disabled|turned off|off|needed|enabled|blocked|switched off)|(?:needs?|requires?|uses) (?:javascript|scripts?|cookies)|blocks? (?:javascript|scripts?)|without (?:javascript|scripts?)|(?:does not|doesn'?t) (?:support|run|allow) (?:javascript|scripts?))"
    r"|\b(?:ohne|sans|sin|sem|zonder|без) (?:\w+ )?(?:javascript|skripte?|scripts?|скрипт\w*|cookies?)\b|(?:javascript|betikler?)\s(?:olmadan|kapalıyken)|(?:javascript|スクリプト)なし"
    r"|(?:etkinleştir(?:in|iniz|meniz|melisiniz)?|açın|izin ver(?:in|iniz|meniz)|gerek(?:tir|iyor|li)|devre dışı|kapalı|engelli(?:yor)?)\b"
    r"|\b(?:aktivieren sie|bitte (?:\w+ )?(?:aktivieren|erlauben|einschalten|zulassen)|schalten sie|erlauben sie|lassen sie|(?:benötigt|braucht|erfordert)|(?:deaktiviert|blockiert|ausgeschaltet)|ist erforderlich|werden benötigt)\b"
    r"|\b(?:veuillez|activez|autorisez|merci d'activer|(?:a besoin|nécessite|requiert|exige)|(?:désactivés?|bloqués?|bloque)|sont nécessaires|est nécessaire)\b"
    r"|\b(?:active|activa|habilite|permita|permitir|(?:necesita|requiere|precisa)|(?:desactivado|bloquea|deshabilitado)s?|por favor)\b"
    r"|\b(?:ative|habilite|permita|ligue|(?:precisa|necessita|requer|exige)|(?:desativado|bloqueia|desabilitado)s?)\b"
    r"|\b(?:schakel|zet|activeer|sta|(?:heeft|vereist|hebben)|(?:uitgeschakeld|geblokkeerd|blokkeert)|nodig|inschakelen|ingeschakeld)\b"
    r"|(?:включите|разрешите|активируйте|(?:нужны|требуется|требуются|необходим\w*)|(?:отключ|блокиру|выключ)\w*)"
    r"|(?:有効に|許可して|オンに|必要です|無効|ブロック)",
    _I,
)
#: Finite verbs of telling; not after an article or the like, where they are nouns (a story, an account, a bed).
_NOUN = "".join(rf"(?<!\b{w} )" for w in ("la", "el", "una", "esta", "su", "tu", "mi", "tua", "sua", "uma", "a", "o", "um", "este", "esa", "essa", "minha", "nova", "nueva", "cada", "le", "un", "ce", "the", "this", "your"))
_TELLS = re.compile(
    r"\b(?:says|said|explains|explained|tells|(?:is|was) read by|laughs|asks|writes|knocks)\b|\b(?:erklärt|sagt|liest|erzählt|schreibt|fragt)\b|\b(?:explique|raconte)\b|\b(?:explica|dice|lee|escribe|diz|lê|escreve)\b|\b(?:legt uit|zegt|leest|vertelt|schrijft)\b"
    rf"|{_NOUN}\b(?:reads|dit|lit|conte|écrit|cuenta|conta)\b|(?:объясняет|говорит|читает|пишет)"
    # who or what tells, as the topic of the line
    r"|^(?:the |this |an? )?(?:lesson|story) (?:on|about)\b|^(?:die |eine |diese )?(?:lektion|geschichte|lehrtext) (?:über|zu)\b|^(?:la |une |cette )?leçon sur\b|^(?:la |una |esta )?lección sobre\b|^(?:a |uma |esta )?(?:lição|aula) sobre\b|^(?:de |een |deze )?les over\b|^(?:этот )?(?:урок|рассказ) (?:о|об|про)\b",
    _I,
)
#: Where the verb comes last it tells what stands before it.
_TOLD = re.compile(r"(?:diyor|anlatıyor|açıklıyor|okuyor|yazıyor|söylüyor)|と(?:[^。]{0,12})(?:説明する|言う|いう|話す|書く)", _I)


def _told(line: str, m: re.Match) -> bool:
    """Whether somebody says or explains the matched message: subject and verb stand
    before its end, or the verb follows it after a comma or quotation mark."""
    for v in _TELLS.finditer(line):
        between = line[v.end() : m.start()] if v.end() <= m.start() else ""
        if v.end() <= m.end() and not re.search(r"[.!?]\s", between):
            return True
        if v.start() >= m.end() and re.search(r"[,\"'“”»’—–]\s*(?:\w+\s){0,2}$", line[m.end() : v.start()]):
            return True
    return bool(_TOLD.search(line, m.start()))


# What a detector needs at least; lines without it are not looked at more closely.
_OPENERS = re.compile(r"[{%$#<\[@_~|&【]")
_LATIN_SIGNS = ("lorem", "ipsum", "dolor", "nibh", "turpis", "mattis", "ornare", "congue", "ligula", "consectetur", "adipiscing")
_VALUE_SIGNS = ("null", "None", "NULL", "undefined", "NaN", "nil")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'“”’»)\]]*\s+|(?<=[。！？!?])[」』”）]*")
#: Openings of messages that also open sentences of a story, unless a page or the like is named.
_NARRATED = re.compile(r"(?:we |we konden|there (?:was|has been) an? |oops|\(?[45]\d\d\)?\s+(?!not found|forbidden|gone|bad |unauthorized|internal |service |gateway |too many|method |request |conflict|payment )\w)", _I)
_PAGE = re.compile(r"\b(?:page|file|site|server|request|browser|recording|content|player|link|url|connection|error|load|try again|pagina|opname|bestand|laden)\b|null|undefined|\bNaN\b|javascript|\bscripts?\b|\bcookies?\b", _I)
_QUOTES = " \t\"'“”‘’«»„「」『』"
_EDGES = " .,:;!?…-–—\"'[]()。、\t"


def _needed(pattern: str) -> set[str]:
    """Literals (lower case) of which every match of a pattern holds one; empty if no
    such set is known. Of the parts of a sequence the one with the longest is taken."""

    def of(items) -> set[str]:
        best: set[str] = set()
        run = ""

        def offer(own: set[str]) -> None:
            nonlocal best
            if own and all(own) and min(map(len, own)) > (min(map(len, best)) if best else 0):
                best = own

        for kind, arg in [*items, (None, None)]:
            if kind == _parser.LITERAL:
                run += chr(arg)
                continue
            offer({run.lower()} if run else set())
            run = ""
            if kind == _parser.BRANCH:
                each = [of(x) for x in arg[1]]
                offer(set().union(*each) if all(each) else set())
            elif kind == _parser.SUBPATTERN:
                offer(of(arg[3]))
            elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0] > 0:
                offer(of(arg[2]))
        return best

    return of(_parser.parse(pattern, _I))


#: What a line may hold, by the literals in it.
_FAIL_BIT, _THING_BIT, _MESSAGE_BIT, _SCRIPT_BIT, _VALUE_BIT, _WEAK_BIT = (1 << i for i in range(6))


def _automaton() -> ahocorasick.Automaton:
    bits: dict[str, int] = {}
    for bit, patterns in ((_FAIL_BIT, [_FAILS]), (_THING_BIT, [_THING]), (_MESSAGE_BIT, [_FAILED, _FAILED_END]), (_SCRIPT_BIT, [_SCRIPT]), (_WEAK_BIT, [_WEAK_SIGN])):
        for p in patterns:
            for literal in _needed(p.pattern):
                bits[literal] = bits.get(literal, 0) | bit
    for sign in _VALUE_SIGNS:
        bits[sign.lower()] = bits.get(sign.lower(), 0) | _VALUE_BIT
    out = ahocorasick.Automaton()
    for literal, bit in bits.items():
        out.add_word(literal, bit)
    out.make_automaton()
    return out


_LITERALS = None


def _bits(text: str) -> tuple[int, int]:
    """(bits, signs): the literals in a text, and how many of them may be weak signs."""
    global _LITERALS
    if _LITERALS is None:
        _LITERALS = _automaton()
    out = signs = 0
    for _, bit in _LITERALS.iter(text.replace("İ", "i").lower()):
        out |= bit
        signs += bit >= _WEAK_BIT
    return out, signs


_STATUS_NUMBER = re.compile(r"(?<!\d)[45]\d\d(?!\d)")


def _outside(line: str, m: re.Match) -> bool:
    """Whether a placeholder is only named as an example."""
    return bool(_BEFORE.search(line[: m.start()]) or _AFTER.search(line[m.end() :]))


def _cycle(words: list[str]) -> bool:
    """Whether a phrase of two to five words is said again and again."""
    plain = [w.strip(_EDGES) for w in words]
    return len(set(plain)) > 1 and any(len(plain) >= max(8, 3 * n) and plain[n:] == plain[:-n] for n in range(2, 6))


def _messages(line: str, alone: bool, bits: int) -> tuple[set[str], bool]:
    """(kinds, weak): failed values, errors and notices in a sentence; weak where it has
    some form of a message, too little to count by itself. ``alone``: nothing else
    stands in its line; ``bits``: literals in it."""
    kinds: set[str] = set()
    weak = False
    low = line.lower()
    body = line.rpartition(" | ")[2].strip() if " | " in line else line
    if bits & _VALUE_BIT:
        for m in _VALUE.finditer(line):
            only = m[0] == line.strip(" .,:;!?()[]\"'")
            after = line[m.end() : m.end() + 1]
            english = m[0] == "None" and (m.start() == 0 and not only and after == " " or re.match(r"\s+(?:of|but|other|too|the|was|were|is|are|could|would|had|has|can|will|knew|came|saw|ever|dared|spoke)\b", line[m.end() :], _I))
            if not english and not _outside(line, m):
                kinds.add("value")
    fails = bits & _FAIL_BIT and bits & _THING_BIT
    narrated = not alone and _NARRATED.match(line) and not _PAGE.search(line)
    if _TRACE.match(line) or _STATUS.match(body) or _NUMBERED.match(body) and _FAILS.search(body) and not _SOMEBODY.search(body):
        kinds.add("error")
    elif bits & _MESSAGE_BIT and (m := _FAILED.match(body) or _FAILED_END.search(body)) and not narrated and not _SOMEBODY.search(body) and (body is not line or not _told(body, m)):
        kinds.add("error")
    elif fails and not narrated and _THING.search(body) and (m := _FAILS.search(body)) and (body is not line or not _told(body, m)):
        strength = _general(body)
        if strength >= STRONG:
            kinds.add("error")
        weak = strength > 0
    if bits & _SCRIPT_BIT and _SCRIPT.search(low) and (m := _TURN_ON.search(body)) and not _told(body, m):
        kinds.add("script")
    return kinds, weak


def _sentences(line: str) -> list[str]:
    out = [x for x in (y.strip(_QUOTES) for y in _SENTENCE.split(line)) if x]
    return [line] if len(out) < 2 or _TRACE.match(line) else out


def line_kinds(line: str) -> set[str]:
    """What stands in place of content in a line: placeholder, value, filler, error, script."""
    return _line(line)[0]


def _line(line: str) -> tuple[set[str], int, int]:
    """(kinds, weak, signs): what stands in place of content in a line, the number of words
    of sentences that only look like a message, and an upper bound of its weak signs."""
    line = line.strip()
    if line and not line[0].isalpha():
        line = _PREFIX.sub("", line)
    if not line:
        return set(), 0, 0
    kinds: set[str] = set()
    low = line.lower()
    if any(k in low for k in _LATIN_SIGNS):
        words = re.findall(r"[^\W\d_]+", low)
        if len(words) >= 4 and sum(w in _LATIN for w in words) >= 0.8 * len(words) and len({w for w in words if w in _LATIN_SURE}) >= min(3, len(set(words))):
            kinds.add("filler")
    start = line.lstrip(_EDGES)
    if (m := _FILL.match(start)) and len(_FILL.sub("", start).strip(_EDGES)) <= max(2, len(m[0]) // 4):
        kinds.add("filler")
    if low.count(low[:7]) >= 4 and _cycle(low.split()):
        kinds.add("filler")
    if _OPENERS.search(line):
        for m in _slots(line):
            if not _outside(line, m):
                kinds.add("placeholder")
        for m in _BRACKET.finditer(line):
            inner = m["in"]
            wide = re.search(r"[぀-ヿ一-鿿]", inner)
            plain = inner.isupper() or inner[1:].lower() == inner[1:] or re.match(rf"(?:{_ASK})", inner, _I)
            if _ASKS.search(inner) and plain and (wide or len(inner.split()) >= 2) and not _outside(line, m):
                kinds.add("placeholder")
        if _OBJECT.search(line):
            kinds.add("value")
    bits, signs = _bits(line)
    fails = bits & _FAIL_BIT and bits & _THING_BIT
    if not (fails or bits & (_MESSAGE_BIT | _SCRIPT_BIT | _VALUE_BIT) or _STATUS_NUMBER.search(line) or _TRACE.match(line)):
        return kinds, 0, signs  # nothing below can match
    sentences = _sentences(line)
    if len(sentences) == 1:
        told = [_messages(sentences[0], True, bits)]
    else:
        told = [_messages(x.rstrip(".") if x[:1].isalpha() else x, False, _bits(x)[0]) for x in sentences]
    return kinds.union(*(k for k, _ in told)), sum(len(x.split()) for x, (_, weak) in zip(sentences, told) if weak), signs


def _terms(t: str) -> set[str]:
    return {w for w in re.findall(r"[^\W\d_]{4,}", t.lower())}


#: A weak sign of a host's message, in any of the languages; needs other evidence too.
_WEAK_SIGN = re.compile(
    r"error|erro\b|erreur|fehler|\bhata\b|\bfout\b|ошибк|エラー|not found|unavailable|expired|denied|server|sunucu|serveur|servidor|сервер|サーバー|javascript|script|betik|skript|スクリプト|скрипт|cookie|session|oturum|sitzung|sessão|sesión|sessie|сеанс|сесси|セッション|browser|tarayıcı|navegador|navigateur|браузер|ブラウザ",
    _I,
)


def evidence(text: str | None, source: str | None) -> tuple[list[str], list[int], float, float, float, str | None]:
    """(kinds, lines, share, mismatch, density, shape): kinds found, numbers of the lines
    with them (from 1), their share of the characters; how little slug and title have to
    do with the body (0 to 1, 1 where they share no term); the share of words in sentences
    that look like a message or in signs of one; and a digest of the text without digits
    and marks. Without a kind, and with signs below ``DENSITY``, nothing can make residue
    of a text: all are 0 or null then."""
    kinds: set[str] = set()
    lines: list[int] = []
    flagged = total = same = weak = most = 0
    plain = _TAG.sub("", text or "")
    rows = plain.split("\n")
    for i, line in enumerate(rows, 1):
        total += len(line.strip())
        k, looks, signs = _line(line)
        weak += looks
        most += signs
        same = same + 1 if i > 1 and line == rows[i - 2] and line.strip() else 0
        if same == 2 and len(_SENTENCE.split(line.strip())) == 1 and "," not in line:  # one plain line three times on end
            k = k | {"filler"}
        if k:
            kinds |= k
            lines.append(i)
            flagged += len(line.strip())
    density = 0.0
    if weak or most:
        words = max(1, len(plain.split()), len(plain) // 12)
        if max(weak, most) >= DENSITY * words:  # fewer signs decide nothing
            found_ = [(x, m) for x in rows for m in _WEAK_SIGN.finditer(x)]
            if weak or found_ and not _told(*found_[0]):
                density = max(weak, len(found_)) / words
    if not kinds and density < DENSITY:
        return [], [], 0.0, 0.0, 0.0, None
    filled = [r for r in rows if r.strip()]
    if kinds & {"error"}:  # the reference number below a message belongs to it
        lines = sorted({*lines, *(i for i, r in enumerate(rows, 1) if _NUMBER.match(r.strip()))})
    title, body = (filled[0], " ".join(filled[1:])) if filled else ("", "")
    head = _terms(title.partition(" | ")[0]) | _terms((source or "").replace("-", " "))
    terms = _terms(body)
    mismatch = 1 - len(head & terms) / max(1, min(len(head), len(terms)))
    return sorted(kinds), lines, flagged / max(1, total), mismatch, density, shape(plain)


def shape(text: str) -> str | None:
    """Digest of a text without its digits, marks and letter case."""
    words = re.sub(r"[\W_]+", " ", re.sub(r"\d+", "0", text.lower())).strip()
    return hashlib.md5(words.encode("utf-8", "surrogatepass")).hexdigest() if words else None


def detect(documents: DataFrame) -> DataFrame:
    """(doc_id, residue, score, kinds, lines, share, mismatch, density, copies, hosts):
    one row a document, residue where the score reaches ``THRESHOLD``.

    kinds: placeholder, value, filler, error, script (by line), host (none of these, but
    signs of a message together with mismatch, density and host evidence: the same text
    served as ``COPIES`` documents of ``HOSTS`` sources). Null and empty texts hold no
    residue; control tags, stage directions and JSON notes are none. Texts and lines are
    read whole, whatever their length. Documents without a source count as one host."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(d, s, *evidence(t, s)) for d, t, s in zip(x["doc_id"], x["text"], x["source"])]
            yield pd.DataFrame(out, columns=["doc_id", "source", "kinds", "lines", "share", "mismatch", "density", "shape"])

    src = documents.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    kind = src.schema["doc_id"].dataType.simpleString()
    seen = written(src.mapInPandas(run, f"doc_id {kind}, source string, kinds array<string>, lines array<int>, share double, mismatch double, density double, shape string"), "evidence")
    # hosts that serve one shape: pairs are made distinct before they are counted
    pairs = seen.filter("shape is not null").groupBy("shape", F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("k"))
    served = pairs.groupBy("shape").agg(F.sum("k").alias("copies"), F.count(F.lit(1)).alias("hosts"))
    shaped = skew_join(seen.filter("shape is not null"), written(served, "shapes"), ["shape"], "doc_id", "left")
    plain = seen.filter("shape is null").withColumns({"copies": F.lit(0).cast("long"), "hosts": F.lit(0).cast("long")})
    both = shaped.unionByName(plain)
    add = lambda on, x: F.when(on, F.lit(x)).otherwise(0.0)
    any_ = (F.size("kinds") > 0) | (F.col("density") > 0)
    score = add(F.size("kinds") > 0, STRONG) + add(F.col("density") > 0, WEAK) + add(any_ & (F.col("mismatch") == 1), MISMATCH)
    score += add(F.col("density") >= DENSITY, DENSE) + add((F.col("copies") >= COPIES) & (F.col("hosts") >= HOSTS), SERVED)
    both = both.withColumn("score", F.round(score, 6))
    residue = F.col("score") >= THRESHOLD
    kinds = F.when(residue & (F.size("kinds") == 0), F.array(F.lit("host"))).otherwise(F.col("kinds"))
    return both.select("doc_id", residue.alias("residue"), "score", kinds.alias("kinds"), "lines", "share", "mismatch", "density", "copies", "hosts")


def found(detected: DataFrame) -> DataFrame:
    """(doc_id) of documents with residue."""
    return detected.filter("residue").select("doc_id")


def clean(documents: DataFrame, detected: DataFrame) -> DataFrame:
    """The documents that are left: all columns of those without residue."""
    return documents.join(detected.filter("not residue").select("doc_id").distinct(), "doc_id", "left_semi")
