"""Word lists, phrases, column names and constants.

Everything here is data that results depend on, stated as plain text. No logic.
"""

# Acronyms that are often glued to the next word.
GLUED_ACRONYMS = ("msf", "acf", "nrc", "crs", "pui", "hi", "mdm")

# Organisation lexicon. A category line, then its keywords.
ORGANISATION_LEXICON = """
red_cross
red cross, red crosses, international committee of the red cross, icrc, ifrc, croix-rouge, croix-rouges, comité international de la croix-rouge, cicr, cruz roja, cruces rojas, comité internacional de la cruz roja, красный крест, красные кресты, международный комитет красного креста, الصليب الأحمر, اللجنة الدولية للصليب الأحمر, 红十字会, 红十字组织, 红十字国际委员会, american red cross, british red cross, ukrainian red cross, german red cross, canadian red cross, australian red cross, japanese red cross, swiss red cross, italian red cross, french red cross, norwegian red cross, swedish red cross, red crescent, red crescents, turkish red crescent, egyptian red crescent, pakistan red crescent, iranian red crescent, syrian red crescent, palestinian red crescent, الهلال الأحمر, جمعية الهلال الأحمر, الهلال الأحمر التركي, الهلال الأحمر الفلسطيني, magen david adom, mda, מגן דוד אדום

msf_solidarist
médecins sans frontières, msf, doctors without borders, première urgence internationale, handicap international, action contre la faim, acf, action against hunger, norwegian refugee council, nrc, doctors of the world, médecins du monde, mdm, terre des hommes, refugees international, human rights watch, hrw, amnesty international, international crisis group, crisis group, reporters without borders, rsf, geneva call, danish refugee council, international medical corps, save the children, vostok sos, right to protection, médicos sin fronteras, acción contra el hambre, refugiados internacionales, врачи без границ, врачи мира, норвежский совет по делам беженцев, правозащитники, амнисти интернешнл, международная кризисная группа, أطباء بلا حدود, أطباء العالم, العمل ضد الجوع, المجلس النرويجي للاجئين, منظمة العفو الدولية, هيومن رايتس ووتش, مجموعة الأزمات الدولية, 无国界医生, 世界医生组织, 对抗饥饿, 挪威难民委员会

faith_based
caritas, caritas ukraine, caritas-spes, crs, catholic relief services, samaritan's purse, world vision, adra, transform ukraine, orthodox christian mission center, iocc, international orthodox christian charities, services catholiques de secours, vision mondiale, servicios católicos de ayuda, visión mundial, каритас, каритас украина, православный христианский миссионерский центр, كاريتاس, كاريتاس أوكرانيا, خدمات الإغاثة الكاثوليكية, رؤية العالم, 明爱, 乌克兰明爱, 天主教救援服务, 世界宣明会

un_agencies
U.N., United Nations, @UN, UN-led, UN-backed, UN-supported, UN-sponsored, UN-run, unhcr, ocha, iom, undp, wfp, unicef, مفوضية الأمم المتحدة لشؤون اللاجئين, برنامج الأمم المتحدة الإنمائي, 联合国, 联合国开发计划署, 联合国儿童基金会

usaid
usaid, us aid agency, us development agency, us international aid, chemonics, dt global, dexis, creative associates international

rossotrudnichestvo
rossotrudnichestvo, rossotrudnichestva, rosstrudnichestvo, rossotrudnichestva agency, russian aid agency, russian humanitarian agency, россотрудничества, россотруднечество, russian red cross, russian aid convoy, russian humanitarian mission

uncategorized
razom for ukraine, nova ukraine
"""

# Terms matched on the raw, case-preserving text, per category.
CASE_SENSITIVE_TERMS = {
    "un_agencies": ("UN", "UN-led", "UN-backed", "UN-supported", "UN-sponsored", "UN-run", "U.N.",
                    "United Nations", "@UN", "WHO", "World Health Organization", "@WHO"),
    "msf_solidarist": ("ACTED", "@ACTED"),
}

# General mentions of organisations, for the fallback class.
GENERAL_TERMS = (
    "ngo", "ngos", "non-governmental organization", "non-governmental organizations",
    "relief agency", "relief agencies", "aid group", "aid groups", "charity", "charities",
    "volunteer organization", "volunteer organizations",
    "humanitarian organization", "humanitarian organizations",
    "relief organization", "relief organizations", "aid agency", "aid agencies",
)
FALLBACK_CATEGORY = "uncategorized"

# Failure statuses in matching order, each with its phrases.
FAILURE_PHRASES = """
protected
only approved followers
protected tweets
solo los seguidores aprobados
nur genehmigte follower
仅限获批准的关注者
فقط المتابعون المعتمدون

age_restricted
might not be appropriate for people under 18
puede no ser apropiado para menores
könnte für Personen unter 18 ungeeignet sein
可能不适合18岁以下的人
قد لا يكون مناسبًا لمن هم دون 18 عامًا

tweet_unavailable
this tweet is unavailable
ce tweet est indisponible
este tweet no está disponible
dieser tweet ist nicht verfügbar
此推文不可用
هذه التغريدة غير متوفرة

account_suspended
account suspended
compte suspendu
cuenta suspendida
konto gesperrt
账户已暂停
تم تعليق الحساب

sensitive_content_block
this media may contain sensitive content
ce média peut contenir du contenu sensible
este contenido puede ser sensible
dieser inhalt kann sensibel sein
此媒体可能包含敏感内容
قد يحتوي هذا الوسائط على محتوى حساس

deleted
this page doesn’t exist
try searching for something else
cette page n'existe pas
cette page est introuvable
esta página no existe
diese seite existiert nicht
此页面不存在
هذه الصفحة غير موجودة
"""

# Interface phrases that are not post text.
JUNK_PHRASES = (
    "accept all cookies", "refuse non-essential cookies", "log in", "open app",
    "see new posts", "download the app", "get the app", "age-restricted adult content",
    "this content might not be appropriate", "learn more", "show more about your choices",
    "sign up", "create account", "view profile", "explore more", "join now", "get started",
    "accepter tous les cookies", "refuser les cookies non essentiels", "se connecter",
    "ouvrir l'application", "ver publicaciones nuevas", "descargar la aplicación",
    "registrarse", "crear cuenta", "查看新帖子", "下载应用", "注册", "创建账户",
    "انضم الآن", "ابدأ", "عرض الملف الشخصي",
)

# Columns of the post table and what routing adds to it.
POST_COLUMNS = (
    "userid", "username", "acctdesc", "location", "following", "followers", "totaltweets",
    "usercreatedts", "tweetid", "tweetcreatedts", "retweetcount", "text", "hashtags", "language",
    "coordinates", "favorite_count", "extractedts",
)
LINEAGE_COLUMNS = ("source_file", "is_duplicate", "multi_category_match", "timezone_assumed")

# Columns of a fetched record.
RECORD_COLUMNS = (
    "tweet_id", "text", "hashtags", "language", "media", "has_link", "views", "retweets", "likes",
    "replies", "quote_count", "URL", "fail_reason", "hydration_score", "summary",
)

# Accepted names per logical column, first match wins.
TEXT_COLUMN_NAMES = ("text", "tweet", "tweet_text", "content", "tweet_bodz")
LANGUAGE_COLUMN_NAMES = ("language", "fil_language")
DUPLICATE_FLAG_NAMES = ("is_duplica", "is_duplicate")
REPOST_COUNT_NAMES = ("retweetco", "retweetcount")

# Cell texts that stand for a missing value in a CSV.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Page markers of a stored post page.
TEXT_TESTID = "tweetText"
MEDIA_TESTIDS = ("tweetPhoto", "videoPlayer", "animatedGif")
METRIC_TESTIDS = {"views": "viewCount", "retweets": "retweet", "likes": "like", "replies": "reply",
                  "quote_count": "quote"}
TITLE_MARKER = "on X:"

# Formats.
PERMALINK = "https://twitter.com/i/web/status/%s"
SHEET_LINK = '=HYPERLINK("https://twitter.com/i/web/status/%s", "View Tweet")'
FAILURE_SEPARATOR = " — "
ID_LIST_END = "FILE INFORMATION"
ID_LIST_GLOB = "tweet_ids*.txt"
SHARD_GLOB = "scraped_worker_*.csv"
FAILURE_GLOB = "failed_worker_*.txt"

# Thresholds.
LANGUAGES = ("en", "ru")
OTHER_LANGUAGE = "other"
LOW_SCORE = 2
MIN_WORD_CHARS = 15
MIN_LANGUAGE_CHARS = 10
MIN_DOC_CHARS = 5
STREAK_LIMIT = 20
MIN_DF = 2
MAX_DF = 0.95
MIN_CLUSTER_SIZE = 5
TIME_BINS = 5
TOP_TERMS = 10
NAME_TERMS = 4
BIN_TERMS = 5
REPRESENTATIVE_DOCS = 3
SENTIMENT_LABELS = ("LABEL_0", "LABEL_1", "LABEL_2")
EMBED_BATCH = 256
SENTIMENT_BATCH = 64
