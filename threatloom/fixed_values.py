"""Word lists, lookup tables, patterns and formats that results depend on.

Everything below is data whose text must stay exactly as it is for results to be right.
Regular expressions are written in Python syntax; ``functions.patterns`` turns them into
the equivalent Java ones.
"""

# ---------------------------------------------------------------- profile names
S1 = "s1"  # bulletin site with Russian section titles
SL = "sl"  # research blog with appendix sections
PP = "pp"  # vendor blog with indicator tables

# ---------------------------------------------------------------- IOC patterns
IPV4 = r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b"
IPV4_PORT = (
    r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"
    r":(?:6553[0-5]|655[0-2]\d|65[0-4]\d{2}|6[0-4]\d{3}|[1-5]?\d{1,4})\b"
)
SHA256 = r"\b[a-fA-F0-9]{64}\b"
SHA1 = r"\b[a-fA-F0-9]{40}\b"
MD5 = r"\b[a-fA-F0-9]{32}\b"
URL_S1 = r"\bhttps?://[^\s<>'\"]+"
URL = r"\bhttps?://[^\s<>'\")\]]+"
DOMAIN = (
    r"\b[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+\b"
)
FILENAME = r"\b[\w() -]+\.(?:exe|dll|lnk|zip|rar|docm|xlsx|xlsm|pdf|js|vbs|hta)\b"  # case-insensitive
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
STRIP_CHARS = ".,;:()[]{}<>'\""
REFANG_STEPS = (
    ("hxxps://", "https://"),
    ("hxxp://", "http://"),
    ("[:]//", "://"),
    ("[.]", "."),
    ("(.)", "."),
    ("［.］", "."),
)

# Kinds a text may yield, in output order, and the hints that narrow them.
KINDS = {
    SL: ("url", "sha256", "sha1", "md5", "ipv4", "domain"),
    PP: ("url", "sha256", "sha1", "md5", "ipv4", "domain", "filename"),
}
GROUP_HINTS = {
    SL: {"mixed_hash": ("sha256", "sha1", "md5"), "mixed_network": ("url", "ipv4", "domain")},
    PP: {},
}
# Kinds with a pattern of their own in profile S1.
S1_PATTERN_KINDS = ("ipv4_port", "ipv4", "sha256", "sha1", "md5", "url", "domain")

# ---------------------------------------------------------------- kind dictionaries (first needle wins)
KIND_NEEDLES = {
    S1: (
        ("ipv4 port combinations", "ipv4_port"),
        ("ipv4", "ipv4"),
        ("urls", "url"),
        ("url", "url"),
        ("sha256", "sha256"),
        ("sha1", "sha1"),
        ("md5", "md5"),
        ("domains", "domain"),
        ("domain", "domain"),
        ("hosts", "domain"),
    ),
    SL: (
        ("sha-256", "sha256"),
        ("sha256", "sha256"),
        ("sha-1", "sha1"),
        ("sha1", "sha1"),
        ("md5", "md5"),
        ("urls", "url"),
        ("url", "url"),
        ("domains and ips", "mixed_network"),
        ("domains & ips", "mixed_network"),
        ("domains and ip", "mixed_network"),
        ("ip addresses", "ipv4"),
        ("ips", "ipv4"),
        ("ip", "ipv4"),
        ("domains", "domain"),
        ("domain", "domain"),
        ("file hashes", "mixed_hash"),
        ("hashes", "mixed_hash"),
    ),
    PP: (
        ("sha256", "sha256"),
        ("sha-256", "sha256"),
        ("sha1", "sha1"),
        ("sha-1", "sha1"),
        ("md5", "md5"),
        ("hash", "hash"),
        ("domain", "domain"),
        ("ip", "ipv4"),
        ("url", "url"),
        ("file", "filename"),
    ),
}

# ---------------------------------------------------------------- index pages
INDEX_SELECTORS = {
    S1: (
        "main article h2 a[href]",
        "article h2 a[href]",
        ".entry-title a[href]",
        ".post-title a[href]",
        "h2 a[href]",
    ),
    SL: ("main h3 a[href]", "h3 a[href]", "article h2 a[href]", "article h3 a[href]"),
    PP: ("a[href]",),
}
S1_IGNORED_TITLES = ("Популярное", "Подписки", "Топы", "Закладки")
S1_SKIP_PREFIXES = ("/page/", "/category/", "/tag/", "/author/", "/feed/", "/wp-content/", "/wp-json/")
SL_SKIP_PATHS = ("/", "/all/", "/all", "/tags/", "/authors/")
SL_ARTICLE_PATH = r"^/[^/]+/\d+/?$"
PP_HOST = "www.proofpoint.com"
PP_ARTICLE_PATH = r"^/us/blog/threat-insight/[a-z0-9][a-z0-9-]*/*$"  # case-insensitive
PP_SKIP_ENDINGS = (
    "/us/blog/threat-insight",
    "/us/blog/threat-insight/preview",
    "/us/blog/threat-insight?page=",
    "/us/blog/threat-insight?",
)
PP_TITLE_TAGS = ("h1", "h2", "h3", "h4")
PP_TITLE_REJECTS = ("read more", "threat insight")
PP_TITLE_LIMIT = 180

# ---------------------------------------------------------------- entry pages
CONTAINER_SELECTORS = {
    S1: (
        "main article .entry-content",
        "main article .post-content",
        "main article .td-post-content",
        "main article .single-content",
        "main article .article-content",
        "main article .wp-block-post-content",
        "main article [class*='content']",
        "article .entry-content",
        "article .post-content",
        "article .td-post-content",
        "article .single-content",
        "article .article-content",
        "article .wp-block-post-content",
        "article [class*='content']",
        "main article",
        "article",
        "main",
    ),
    SL: (
        "article .post-content",
        "article .entry-content",
        "article .single-content",
        "article .article-content",
        "article [class*='content']",
        "main article",
        "article",
        "main",
        "body",
    ),
    PP: (
        "main article",
        "article",
        "main [class*='blog']",
        "main [class*='post']",
        "main [class*='content']",
        "main",
        "body",
    ),
}
S1_ARTICLE_SELECTORS = ("main article", "article")
S1_SECTION_TITLE = "индикаторы компрометации"
SECTION_PATTERNS = {  # case-insensitive
    SL: r"(?:appendix\s*[ivx]+\s*[–-]\s*)?indicators?\s+of\s+compromise",
    PP: r"(?:example\s+)?indicators?\s+of\s+compromise",
}
SECTION_HEADING_TAGS = {
    S1: ("h1", "h2", "h3", "h4", "h5", "h6"),
    SL: ("h2", "h3", "h4"),
    PP: ("h2", "h3", "h4"),
}
SECTION_STOP_TAGS = ("h1", "h2")  # SL and PP
BLOCK_HEADING_TAGS = {S1: ("h2", "h3", "h4", "h5", "h6"), SL: ("h2", "h3", "h4", "h5"), PP: ("h2", "h3", "h4", "h5")}
PROSE_TAGS = ("p", "div", "section", "figure", "blockquote")
S1_TAB_CLASS = "tabcontent"
S1_NESTED_TEXT_TAGS = ("li", "code", "pre", "p")
S1_PROTECTED_MARKERS = ("доступно только авторизованным пользователям", "присоединиться")
PP_TABLE_HEADER_CELLS = 8
PP_TABLE_INDICATOR = "indicator"
PP_TABLE_CONTEXT = ("description", "type", "context", "first seen")

# ---------------------------------------------------------------- HTML
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta",
    "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer",
)
HIDDEN_TEXT_TAGS = ("rt", "rp", "style", "script", "template")

# ---------------------------------------------------------------- quality rules
SPECIAL_IPV4_BLOCKS = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.88.99.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
    "255.255.255.255/32",
)
ALLOWED_IPV4 = ("192.0.0.9", "192.0.0.10")
INTERNAL_SUFFIXES = (".local", ".localdomain", ".localhost", ".internal", ".intranet", ".lan", ".home", ".corp")
INTERNAL_HOSTS = ("localhost", "localdomain")
DOMAIN_MAX_LENGTH = 253

# ---------------------------------------------------------------- STIX
STIX_NAMESPACE = "00abedb4-aa42-466c-9c01-fed23315a9b7"
DOMAIN_KINDS = ("domain", "domains", "host names", "hostname", "hostnames", "onion domains")
URL_KINDS = ("url", "urls")
TOX_KINDS = ("tox id", "tox", "tox ids")
HASH_NAMES = {"md5": "MD5", "sha1": "SHA-1", "sha256": "SHA-256"}
REPORT_TYPE = "threat-report"
IDENTITY_CLASS = "organization"
REFERENCE_DESCRIPTION = "Original publication URL"
DESCRIPTION_LIMIT = 20_000
DESCRIPTION_CUT = 19_997
DESCRIPTION_TAIL = "..."

# ---------------------------------------------------------------- Suricata
START_SID = 7000000
NO_REFERENCE_URL = "https://example.invalid/no-reference"
IPV4_RULE = (
    "alert ip any any <> {indicator} any "
    '(msg:"TI IOC IPv4: {indicator}"; '
    "threshold:type limit, track ip_pair, count 1, seconds 120; "
    "reference:url,{reference_url}; "
    "classtype:trojan-activity; "
    "sid:{sid}; rev:1;)"
)
DOMAIN_RULE = (
    "alert dns $HOME_NET any -> any any "
    '(msg:"TI IOC domain: {indicator}"; '
    "threshold:type limit, track by_src, count 1, seconds 120; "
    'dns.query; dotprefix; content:".{indicator}"; endswith; '
    "reference:url,{reference_url}; "
    "classtype:trojan-activity; "
    "sid:{sid}; rev:1;)"
)

# ---------------------------------------------------------------- snapshots and reports
SNAPSHOT_SCHEMA_VERSION = 2
SNAPSHOT_KINDS = ("index", "entry")
RETENTION_DAYS = 30
PREVIEW_SIZE = 10
SUCCESS_RATE_TARGET = 95
