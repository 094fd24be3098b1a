"""Labelled residue exemplars, in the languages of the corpus: the default of the operator's ``exemplars`` parameter.

``*`` stands for a name or a few words, ``#`` for a number. Labels: ``mark`` (a place left to fill in), ``notice`` (scripts
are required), ``error`` (an error page's message), ``filler``. The form tells how a match is made: ``mark`` (its words and signs
in a paragraph, then its exact form), ``passage`` (its words in a window), ``line`` (its words and no others on a line), ``style``
(filler that has no wording: an opening, and the look of its words).
"""

#: Marks of signs alone; the gap is a name.
SIGNED = ["{{ * }}", "${ * }", "#{ * }", "{*}", "__*__", "$*$", "%*%", "%(*)s", "<%= * %>", "<% * %>", "[[ * ]]", "@@*@@"]

MARKS = [
    "[insert *]", "[insert * here]", "[add *]", "[add * here]", "[enter *]", "[* goes here]", "[describe *]", "[describe the *]", "[your *]", "[your * here]",
    "<insert *>", "<insert * here>", "<add *>", "<add * here>", "<enter *>", "<your *>", "<your * here>", "<* here>", "<* goes here>",
    "(fill in *)", "(insert *)", "(add * here)", "[fill in *]", "<fill in *>", "todo: write the *", "todo: add the *", "todo: describe the *", "type the * over this line",
    "<!-- say what the * is and delete this line -->", "<!-- describe the * -->", "<!-- replace this * -->", "replace this line with *",
    "[bitte * eintragen]", "<hier * einfügen>", "[hier * einfügen]", "(beschreibung fehlt noch: *)", "<bitte * ergänzen>", "[ihr *]",
    "[votre *]", "<votre *>", "[insérer * ici]", "<insérer * ici>", "<à compléter : *>", "[à compléter : *]", "(à compléter)",
    "[inserte * aquí]", "<inserte * aquí>", "<escriba su *>", "[escriba su *]", "[completar *]", "<completar *>", "[su * aquí]",
    "【ここに*を入力】", "〈*を記入してください〉", "【*を記入してください】", "〈ここに*を入力〉", "〈此处输入*〉", "【请在此填写*】", "【此处输入*】", "〈请填写*〉",
]

NOTICES = [
    "please turn on javascript in your browser to view *", "please enable javascript to view *", "please enable javascript and cookies to continue",
    "you need to enable javascript to run this app", "your browser has javascript disabled so nothing can be shown here", "javascript must be enabled change the setting and reload",
    "javascript is disabled in your browser", "* does not work without javascript", "this site requires javascript", "to run *, switch javascript on first", "sorry, * isn't of much use while javascript is off",
    "one moment, we are looking at your browser cookies and javascript must be on", "cookies and javascript must be on", "<noscript>javascript required for *</noscript>", "loading (needs javascript)",
    "bitte schalten sie javascript ein, um diese seite zu nutzen", "bitte aktivieren sie javascript", "diese anwendung läuft nur mit aktivierten skripten",
    "ihr browser führt keine skripte aus ohne sie bleibt die ansicht leer",
    "veuillez activer javascript pour afficher cette page", "cette application ne fonctionne pas sans javascript", "les scripts sont désactivés dans votre navigateur ; activez-les pour continuer",
    "active javascript en su navegador para ver esta página", "esta aplicación no funciona sin javascript", "su navegador tiene los scripts desactivados; actívelos y recargue",
    "このページを表示するには javascript を有効にしてください", "スクリプトが無効になっています 設定を変更してください", "このアプリは javascript なしでは動作しません",
    "请启用 javascript 后再访问本页面", "您的浏览器已禁用脚本，无法显示内容", "本应用需要 javascript 才能运行",
]

ERRORS = [
    "the page you asked for is not here", "the page you are looking for could not be found", "the requested url was not found on this server", "this address has moved or never was",
    "something broke on our side", "something went wrong please try again", "an unexpected error occurred while this page was drawn", "our desk is down for maintenance",
    "we are down for maintenance please check back soon", "the server behind this address gave no answer", "the server encountered an internal error and was unable to complete your request", "the connection timed out",
    "this pull request could not be loaded", "you may not view this thread", "you do not have permission to access this page", "you have asked too often", "too many requests, slow down",
    "your session has ended", "your session has expired please sign in again", "sign in again to go on", "contact the desk and name *",
    "{\"error\":{\"code\":#,\"message\":\"*\",\"request\":\"*\"}}", "{\"message\": \"not found\", \"status\": \"#\", \"id\": \"*\"}", "{\"ok\":false,\"reason\":\"upstream timeout\",\"trace\":\"*\"}",
    "<?xml version=\"1.0\"?><fault><code>#</code><detail>object is missing</detail><ref>*</ref></fault>",
    "<html><head><title>error #</title></head><body><h1>error #</h1><hr>", "<html><head><title># not found</title></head><body><h1># not found</h1><hr>",
    "<html><head><title># forbidden</title></head><body><h1># forbidden</h1><hr>", "<html><head><title>bad gateway (#)</title></head><body><h1>bad gateway (#)</h1><hr>",
    "interner serverfehler vorgang *", "zugriff verweigert bitte melden sie sich an", "der dienst ist zurzeit nicht erreichbar versuchen sie es später noch einmal", "fehler #: die angeforderte seite wurde nicht gefunden",
    "une erreur interne est survenue réf", "accès refusé veuillez vous connecter", "le service est momentanément indisponible, réessayez plus tard", "erreur # : la page demandée est introuvable",
    "se produjo un error interno referencia *", "acceso denegado inicie sesión para continuar", "el servicio no está disponible en este momento vuelva a intentarlo", "error #: no se encontró la página solicitada",
    "エラー #: お探しのページは見つかりませんでした", "アクセスが拒否されました ログインしてください", "ただいまメンテナンス中です", "サーバー内部でエラーが発生しました",
    "错误 #：找不到您请求的页面", "访问被拒绝，请先登录", "系统维护中，请稍后再试", "服务器内部错误",
]

#: Short messages that count only where they are all of a line.
ERROR_LINES = [
    "error #", "http #", "# not found", "# forbidden", "page not found", "not found", "access denied", "service unavailable", "bad gateway", "internal server error", "too many requests", "gateway timeout",
]

FILLERS = ["lorem ipsum", "lorem ipsum dolor sit amet", "this is filler so that the page has a body", "it says nothing and will be replaced", "this text is only a placeholder and will be replaced"]

#: Wording in general use, copied from no text of the corpus, though such texts were known when it was written. Many entries of the lists above were labelled in them.
GENERAL_NOTICES = [
    "javascript is required to view this *", "javascript is required for *", "you must enable javascript to use *", "enable javascript in your browser settings",
    "please switch on javascript in your browser", "your browser does not support javascript", "javascript is turned off in your browser", "* needs javascript to work",
    "cannot be shown without javascript", "turn javascript on and reload the page", "javascript ist deaktiviert bitte aktivieren sie es",
    "bitte aktivieren sie skripte in ihrem browser", "ohne javascript kann diese seite nicht angezeigt werden", "javascript est désactivé dans votre navigateur",
    "vous devez activer javascript pour utiliser *", "ce site nécessite javascript", "debe activar javascript para usar *", "javascript está desactivado en su navegador",
    "este sitio requiere javascript", "javascript を有効にして再読み込みしてください", "お使いのブラウザでは javascript が無効です", "请在浏览器中启用 javascript", "您的浏览器不支持 javascript",
]
GENERAL_ERRORS = [
    "the page could not be found", "the page you requested does not exist", "the page has moved to a new address", "something went wrong on our end", "an unexpected error occurred",
    "* is down for maintenance", "the server did not answer", "the server gave no response", "could not be loaded please try again", "you may not view *",
    "you are not allowed to view this page", "too many requests please wait and try again", "you have been signed out please sign in",
    "your session is over sign in again", "please contact support and quote *", "ein interner fehler ist aufgetreten", "die seite wurde nicht gefunden",
    "der zugriff wurde verweigert", "der server ist nicht erreichbar bitte versuchen sie es später", "une erreur est survenue", "la page est introuvable", "accès refusé",
    "le service est indisponible réessayez plus tard", "se ha producido un error", "la página no existe", "acceso denegado",
    "el servicio no está disponible vuelva a intentarlo", "ページが見つかりません", "メンテナンス中です", "アクセスできません ログインしてください", "页面不存在", "系统正在维护", "访问被拒绝",
]
GENERAL_FILLERS = [
    "this is placeholder text", "this is filler text", "filler text to be replaced", "sample text goes here",
]

#: Openings of filler whose words are made up: placeholder Latin, and keys struck along a row of the keyboard.
STYLES = [
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat "
    "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum",
    "qwertyuiop asdfghjkl zxcvbnm",
]

EXEMPLARS = [
    *[("mark", "mark", t) for t in (*SIGNED, *MARKS)], *[("notice", "passage", t) for t in (*NOTICES, *GENERAL_NOTICES)], *[("error", "passage", t) for t in (*ERRORS, *GENERAL_ERRORS)],
    *[("error", "line", t) for t in ERROR_LINES], *[("filler", "passage", t) for t in (*FILLERS, *GENERAL_FILLERS)], *[("filler", "style", t) for t in STYLES],
]
