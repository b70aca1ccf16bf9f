"""Word lists, lookup tables, patterns, weights and thresholds.

Everything in this module is a plain value that results depend on.  None of it grows with the data.
"""

from __future__ import annotations

# --- fixed values: provider fingerprints ------------------------------------------------------------------------

MX_PATTERNS = {
    "ms365": ["mail.protection.outlook.com", "mx.microsoft", "mail.protection.outlook.de", "mail.eo.outlook.com"],
    "google": ["aspmx.l.google.com", "googlemail.com", "smtp.google.com"],
    "aws": ["amazonaws.com", "awsapps.com"],
}
SPF_INCLUDES = {
    "ms365": ["spf.protection.outlook.com"],
    "google": ["_spf.google.com"],
    "aws": ["amazonses.com"],
}
DKIM_SELECTORS = {"ms365": ["selector1", "selector2"], "google": ["google", "google2048"], "aws": []}
DKIM_CNAME_PATTERNS = {
    "ms365": ["onmicrosoft.com"],
    "google": ["domainkey.google.com"],
    "aws": ["dkim.amazonses.com"],
}
AUTODISCOVER_PATTERNS = {"ms365": ["autodiscover.outlook.com"], "google": ["google.com"], "aws": ["awsapps.com"]}
CNAME_PATTERNS = {
    "ms365": ["mail.protection.outlook.com", "mx.microsoft"],
    "google": ["google.com", "googlemail.com"],
    "aws": ["amazonaws.com", "awsapps.com"],
}
DMARC_PATTERNS = {"ms365": ["rua.agari.com"], "google": [], "aws": []}
SMTP_PATTERNS = {
    "ms365": ["microsoft esmtp mail service", "protection.outlook.com", "mx.microsoft"],
    "google": ["mx.google.com", "google esmtp"],
    "aws": ["amazonaws", "amazonses"],
}
TXT_PATTERNS = {"ms365": ["ms=ms"], "google": ["google-site-verification="], "aws": ["amazonses"]}
ASNS = {"ms365": [8075], "google": [15169, 396982], "aws": [16509, 14618]}

# --- fixed values: mail gateways, in order of precedence ----------------------------------------------------------

GATEWAYS = {
    "seppmail": ["seppmail.cloud", "seppmail.com"],
    "cleanmail": ["cleanmail.ch", "cleanmail.safecenter.ch"],
    "barracuda": ["barracudanetworks.com", "barracuda.com"],
    "trendmicro": ["tmes.trendmicro.eu", "tmes.trendmicro.com"],
    "hornetsecurity": ["hornetsecurity.com", "hornetsecurity.ch"],
    "antispameurope": ["antispameurope.com"],
    "proofpoint": ["ppe-hosted.com", "pphosted.com"],
    "sophos": ["hydra.sophos.com"],
    "cisco": ["iphmx.com"],
    "mimecast": ["mimecast.com"],
    "spamvor": ["spamvor.com"],
    "abxsec": ["abxsec.com"],
    "messagelabs": ["messagelabs.com"],
    "fortimail": ["fortimail.", "fortimailcloud.com"],
    "nospamproxy": ["nospamproxy.de", "nospamproxy.com"],
    "retarus": ["retarus.com"],
    "spamexperts": ["spamexperts.eu", "spamexperts.net", "spamexperts.com"],
    "ikarus": ["mymailwall.com", "mymailwall.at"],
    "secureshield": ["secure-shield.at"],
    "secumail": ["secumail.de"],
    "securemailgate": ["secure-mailgate.com"],
    "europeanmx": ["europeanmx.eu"],
}

# --- fixed values: evidence kinds in assembly order, and their weights --------------------------------------------

KINDS = [
    "mx", "spf", "dkim", "dmarc", "autodiscover", "cname_chain", "smtp", "tenant", "asn", "txt_verification", "spf_ip",
]
WEIGHTS = {
    "mx": 0.20, "spf": 0.20, "dkim": 0.15, "dmarc": 0.02, "autodiscover": 0.08, "cname_chain": 0.03,
    "smtp": 0.04, "tenant": 0.10, "asn": 0.03, "txt_verification": 0.07, "spf_ip": 0.08,
}
PRIMARY_KINDS = ["mx", "spf", "dkim", "autodiscover"]
SIGNAL_BOOST = 0.02
GATEWAY_DKIM_BOOST = 0.06

# --- fixed values: confidence rules, first match wins: name, kinds, gateway needed, base confidence ---------------

PROVIDER_RULES = [
    ("mx_spf", ["mx", "spf"], False, 0.90),
    ("mx_only", ["mx"], False, 0.80),
    ("spf_gw", ["spf"], True, 0.70),
    ("dkim_gw", ["dkim"], True, 0.65),
    ("dkim_spf", ["dkim", "spf"], False, 0.60),
    ("spf_only", ["spf"], False, 0.50),
    ("fallback", [], False, 0.40),
]
COUNTRY_RULES = {
    "domestic": [("dom_mx_spf", 0.80), ("dom_mx_only", 0.70), ("dom_secondary", 0.20), ("dom_none", 0.00)],
    "foreign": [("frgn_mx_spf", 0.60), ("frgn_mx_only", 0.50), ("frgn_secondary", 0.10), ("frgn_none", 0.00)],
}
RULE_NAMES = (
    [rule[0] for rule in PROVIDER_RULES]
    + ["gateway_no_primary"]
    + [name for name, _ in COUNTRY_RULES["domestic"]]
    + [name for name, _ in COUNTRY_RULES["foreign"]]
)

# --- fixed values: provider names in outputs ----------------------------------------------------------------------

OUTPUT_PROVIDERS = ["microsoft", "google", "aws", "domestic", "foreign", "unknown"]
OVERRIDE_PROVIDERS = ["microsoft", "google", "aws", "domestic", "foreign"]
US_CLOUD = ["microsoft", "google", "aws"]
COUNTRIES = ["de", "at", "ch"]
COUNTRY_NAMES = {"ch": "Switzerland", "de": "Germany", "at": "Austria"}

# --- fixed values: regions ----------------------------------------------------------------------------------------

REGION_ABBREVIATIONS = {
    "ch": {
        "Kanton Zürich": "zh", "Kanton Bern": "be", "Kanton Luzern": "lu", "Kanton Uri": "ur", "Kanton Schwyz": "sz",
        "Kanton Obwalden": "ow", "Kanton Nidwalden": "nw", "Kanton Glarus": "gl", "Kanton Zug": "zg",
        "Kanton Freiburg": "fr", "Kanton Solothurn": "so", "Kanton Basel-Stadt": "bs", "Kanton Basel-Landschaft": "bl",
        "Kanton Schaffhausen": "sh", "Kanton Appenzell Ausserrhoden": "ar", "Kanton Appenzell Innerrhoden": "ai",
        "Kanton St. Gallen": "sg", "Kanton Graubünden": "gr", "Kanton Aargau": "ag", "Kanton Thurgau": "tg",
        "Kanton Tessin": "ti", "Kanton Waadt": "vd", "Kanton Wallis": "vs", "Kanton Neuenburg": "ne",
        "Kanton Genf": "ge", "Kanton Jura": "ju",
    },
    "de": {
        "Schleswig-Holstein": "sh", "Hamburg": "hh", "Niedersachsen": "ni", "Bremen": "hb",
        "Nordrhein-Westfalen": "nw", "Hessen": "he", "Rheinland-Pfalz": "rp", "Baden-Württemberg": "bw",
        "Bayern": "by", "Saarland": "sl", "Berlin": "be", "Brandenburg": "bb", "Mecklenburg-Vorpommern": "mv",
        "Sachsen": "sn", "Sachsen-Anhalt": "st", "Thüringen": "th",
    },
    "at": {
        "Burgenland": "b", "Kärnten": "k", "Niederösterreich": "nö", "Oberösterreich": "oö", "Salzburg": "s",
        "Steiermark": "st", "Tirol": "t", "Vorarlberg": "v", "Wien": "w",
    },
}
REGION_DISPLAY = {
    "Baden-Württemberg": "Bad.-Württ.", "Mecklenburg-Vorpommern": "Meckl.-Vorp.", "Niedersachsen": "Niedersachs.",
    "Nordrhein-Westfalen": "NRW", "Rheinland-Pfalz": "Rheinl.-Pf.", "Sachsen-Anhalt": "Sachs.-Anh.",
    "Schleswig-Holstein": "Schles.-Hol.", "Niederösterreich": "Niederöst.", "Oberösterreich": "Oberösterr.",
    "Appenzell Ausserrhoden": "Appenzell A.", "Appenzell Innerrhoden": "Appenzell I.",
    "Basel-Landschaft": "Basel-Land",
}
MAX_REGION_LENGTH = 18

REGION_BY_PREFIX = {
    "de": {
        "01": "Schleswig-Holstein", "02": "Hamburg", "03": "Niedersachsen", "04": "Bremen",
        "05": "Nordrhein-Westfalen", "06": "Hessen", "07": "Rheinland-Pfalz", "08": "Baden-Württemberg",
        "09": "Bayern", "10": "Saarland", "11": "Berlin", "12": "Brandenburg", "13": "Mecklenburg-Vorpommern",
        "14": "Sachsen", "15": "Sachsen-Anhalt", "16": "Thüringen",
    },
    "at": {
        "1": "Burgenland", "2": "Kärnten", "3": "Niederösterreich", "4": "Oberösterreich", "5": "Salzburg",
        "6": "Steiermark", "7": "Tirol", "8": "Vorarlberg", "9": "Wien",
    },
}
PREFIX_LENGTH = {"de": 2, "at": 1}
AT_REGION_SUFFIX = {
    "Burgenland": "bgld.gv.at", "Kärnten": "ktn.gde.at", "Niederösterreich": "noe.gv.at",
    "Oberösterreich": "ooe.gv.at", "Salzburg": "salzburg.gv.at", "Steiermark": "stmk.gv.at", "Tirol": "tirol.gv.at",
    "Vorarlberg": "vlbg.gv.at", "Wien": "wien.gv.at",
}

# --- fixed values: country settings of the resolve stage ----------------------------------------------------------

TLDS = {
    "de": ".de .bayern .nrw .saarland .berlin .hamburg .koeln .cologne .ruhr .org .com .net".split(),
    "at": ".at .gv.at .gde.at .co.at .or.at .tirol .wien .org .com .net".split(),
    "ch": ".ch .swiss .zuerich .org .com .net".split(),
}
GOVERNMENT_TLDS = {"de": [], "at": [".gv.at", ".gde.at"], "ch": []}
SKIP_DOMAINS = {
    "de": """
        example.com example.ch sentry.io w3.org gstatic.com googleapis.com schema.org gmail.com hotmail.com hotmail.ch
        outlook.com gmx.ch bluewin.ch yahoo.com domain.com google.com mail.com wordpress.org web.de gmx.de gmx.net
        gmx.at t-online.de freenet.de arcor.de aol.de aol.com yahoo.de posteo.de mailbox.org tutanota.com
        protonmail.com icloud.com teleworm.us example.de hirsch-woelfl.de inixmedia.de nolis.de b-ite.de
        die-netzwerkstatt.de chamaeleon.de daik.de advantic.de realrgb.de egotec.com mustermail.de riewerts.io
    """.split(),
    "at": """
        example.com example.ch sentry.io w3.org gstatic.com googleapis.com schema.org gmail.com hotmail.com hotmail.ch
        outlook.com gmx.ch bluewin.ch yahoo.com domain.com google.com mail.com wordpress.org aon.at gmx.at gmx.net
        chello.at a1.net three.at inode.at wvnet.at cnv.at netway.at utanet.at tele2.at speed.at liwest.at kabsi.at
        wavenet.at sbg.at riskommunal.net gem2go.at kommunalnet.at icloud.com protonmail.com tutanota.com web.de
        gmx.de t-online.de live.at live.com hotmail.de hotmail.at yahoo.de yahoo.at outlook.at silverserver.at
        citiesapps.com
    """.split(),
    "ch": """
        example.com example.ch domain.com sentry.io w3.org gstatic.com googleapis.com schema.org google.com
        group.calendar.google.com wordpress.org defiant.com schedulista.com gmail.com hotmail.com hotmail.ch
        hotmail.fr hotmail.it outlook.com gmx.ch gmx.net bluewin.ch bluemail.ch yahoo.com yahoo.fr mail.com
        windowslive.com ymail.com protonmail.com protonmail.ch icloud.com sunrise.ch hispeed.ch swissonline.ch
        vtxnet.ch netplus.ch netconsult.ch bbf.ch dp-wired.de talus.ch hemmer.ch contactmail.ch zurich-airport.com
        avasad.ch post.ch hin.ch
    """.split(),
}
SUBPAGES = {
    "de": "/kontakt /kontakt/ /impressum /impressum/ /rathaus /verwaltung /buergerservice".split(),
    "at": """
        /kontakt /kontakt/ /impressum /impressum/ /rathaus /gemeinde /verwaltung /buergerservice /buergerservice/
        /service
    """.split(),
    "ch": """
        /kontakt /contact /impressum /kontakt/ /contact/ /impressum/ /de/kontakt /fr/contact /it/contatto /verwaltung
        /administration /autorites /gemeinde /commune /comune
    """.split(),
}
GUESS_TEMPLATES = {
    "de": """
        {slug}.de stadt-{slug}.de gemeinde-{slug}.de markt-{slug}.de vg-{slug}.de samtgemeinde-{slug}.de amt-{slug}.de
        {slug}-online.de {slug}-info.de
    """.split(),
    "at": """
        {slug}.at {slug}.gv.at gemeinde-{slug}.at stadt-{slug}.at marktgemeinde-{slug}.at stadtgemeinde-{slug}.at
        {slug}.or.at {slug}-online.at {slug}-info.at
    """.split(),
    "ch": """
        {slug}.ch gemeinde-{slug}.ch commune-de-{slug}.ch comune-di-{slug}.ch stadt-{slug}.ch {slug}-online.ch
        {slug}-info.ch
    """.split(),
}
REGION_GUESS_TEMPLATES = {
    "de": [],
    "at": ["{slug}.{region}"],
    "ch": ["{slug}.{region}.ch", "{slug}-{region}.ch", "{region}-{slug}.ch", "{slug}{region}.ch"],
}
STRICT_PREFIXES = """
    gemeinde- gemeinde stadt- stadt commune-de- comune-di- markt- markt marktgemeinde- marktgemeinde stadtgemeinde-
    stadtgemeinde
""".split()
AT_PREPOSITIONS = ["an der", "ob der", "in der", "am", "im", "bei"]
FRENCH_ACCENTS = ("éèêëàâôîùûçï", "eeeeaaoiuuci")

# Coarse source of a candidate label; every label not listed counts as static.
SOURCE_GROUPS = {
    "wikidata": "wikidata", "guess": "guess", "scrape": "scrape", "redirect": "redirect", "override": "override",
}
UNVERIFIED_EMAIL_SOURCES = ["bresu_email", "guess"]

BLOCKLIST_SHARE = 0.005
BLOCKLIST_FLOOR = 5
RELEVANCE_KEEP = 0.4

# --- fixed values: page extraction --------------------------------------------------------------------------------

EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
RESERVED_DOMAINS = ["example.com", "example.org", "example.net", "test", "localhost", "invalid"]
SPECIAL_USE_TLDS = ["arpa", "invalid", "local", "localhost", "onion", "test"]
ASSET_EXTENSIONS = """
    png jpg jpeg gif svg webp ico bmp tiff css js woff woff2 ttf eot map pdf zip xml json
""".split()
REDIRECT_BLOCKLIST = ["immoscout24.", "2reserve.", "widgets.worldsoft", "map.apps.", "map.vsgis.", "egov-service."]
SHIFT_RANGES = [(0x2B, 0x3A), (0x40, 0x5A), (0x61, 0x7A)]
MAX_SHIFT = 25
CONTACT_KEYWORDS = """
    kontakt contact impressum verwaltung email e-mail administration autorites comune commune rathaus buergerservice
    service direktion
""".split()
LINK_ASSET_PATTERN = r"(?i)\.(pdf|jpg|jpeg|png|gif|svg|css|js|zip|doc|xlsx?)$"
MUNICIPAL_WORDS = [
    "gemeinde", "stadtverwaltung", "rathaus", "bürgerservice", "bürgermeister", "verwaltung", "amtlich",
    "gemeindeamt", "einwohner", "ortsvorsteher", "ortsgemeinde", "amtsgericht",
    "commune", "mairie", "administration communale", "syndic", "municipalité", "conseil communal",
    "secrétariat communal",
    "comune", "municipio", "amministrazione comunale", "sindaco", "segreteria comunale", "cancelleria comunale",
]
PARKED_WORDS = [
    "domain is for sale", "this domain is parked", "buy this domain", "domain parking", "unter konstruktion",
    "under construction", "coming soon", "website nicht verfügbar", "diese domain steht zum verkauf", "godaddy",
    "sedo.com", "aftermarket", "hugedomains", "dan.com",
]
# --- fixed values: time to live of observations, in days ----------------------------------------------------------

TTL_DAYS = {"head": 1, "scrape": 7, "mx": 1, "dns": 1, "content": 7}

# --- fixed values: reports ----------------------------------------------------------------------------------------

CONFIDENCE_BUCKETS = [(90, 100), (80, 90), (70, 80), (60, 70), (50, 60), (0, 50)]
LOW_CONFIDENCE = 60.0
EXPORT_COLUMNS = """
    country code name region domain provider category confidence gateway mx spf scan_valid dane_supported dane_partial
    has_spf has_good_spf has_dmarc has_good_dmarc classification_signals sources resolve_flags
""".split()
SECURITY_METRICS = ["has_spf", "has_good_spf", "has_dmarc", "has_good_dmarc", "dane_supported"]
CHART_GROUPS = {"de-based": "Domestic", "at-based": "Domestic", "ch-based": "Domestic", "us-cloud": "US Cloud"}
MX_OPERATORS = [
    ("rzone.de", "Strato"), ("infomaniak", "Infomaniak"), ("ionos.de", "IONOS"), ("ionos.com", "IONOS"),
    ("kasserver.com", "All-Inkl"), ("format-ag.ch", "format-ag"), ("hostpoint.ch", "Hostpoint"),
    ("ekom21", "ekom21"), ("kgrz", "ekom21"), ("kvnbw.de", "KVNBW"), ("seppmail", "SEPPmail"), ("sophos", "Sophos"),
]
VENDORS = [
    ("Microsoft", "hyperscaler", "mail.protection.outlook.com outlook.com microsoft office365 onmicrosoft "
     "spf.protection.outlook.com sharepointonline"),
    ("Google", "hyperscaler", "google googlemail gmail aspmx.l.google.com _spf.google.com"),
    ("AWS", "hyperscaler", "amazonaws amazonses awsdns"),
    ("Mailchimp", "foreign", "mandrillapp.com mandrill mcsv.net"),
    ("SendGrid", "foreign", "sendgrid"), ("Mailjet", "foreign", "mailjet"), ("Mailgun", "foreign", "mailgun"),
    ("Brevo", "foreign", "sendinblue brevo"), ("MailChannels", "foreign", "mailchannels"),
    ("SMTP2GO", "foreign", "smtp2go"), ("Newsletter2Go", "foreign", "nl2go"), ("HubSpot", "foreign", "hubspotemail"),
    ("KnowBe4", "foreign", "knowbe4"), ("Sophos", "foreign", "sophos sophosxl"),
    ("Trend Micro", "foreign", "trendmicro"), ("Hornetsecurity", "foreign", "hornetsecurity hornetdmarc"),
    ("Barracuda", "foreign", "barracudanetworks"), ("MailerLite", "foreign", "mlsend"),
    ("Campaign Monitor", "foreign", "createsend"), ("Exclaimer", "foreign", "exclaimer"),
    ("turboSMTP", "foreign", "turbo-smtp"), ("Letsignit", "foreign", "letsignit"), ("CodeTwo", "foreign", "codetwo"),
    ("Freshservice", "foreign", "freshservice"), ("Proofpoint", "foreign", "ppe-hosted pphosted"),
    ("Vade Secure", "foreign", "vadesecure"), ("Fortinet FortiMail", "foreign", "fortimailcloud"),
    ("SpamTitan", "foreign", "spamtitan"), ("SpamExperts", "foreign", "spamexperts antispamcloud"),
    ("Cisco IronPort", "foreign", "iphmx"), ("MailControl", "foreign", "mailcontrol"),
    ("Mimecast", "foreign", "mimecast"), ("MessageLabs", "foreign", "messagelabs"),
    ("MTARoutes", "foreign", "mtaroutes"), ("Jimdo", "foreign", "jimdo"), ("Aruba", "foreign", "arsmtp"),
    ("StackMail", "foreign", "stackmail"), ("Haufe", "foreign", "umantis"),
    ("Email Signatures 365", "foreign", "emailsignatures365 signature365"), ("CleverReach", "foreign", "crsend"),
    ("MailerSend", "foreign", "mailersend"), ("Rackspace", "foreign", "emailsrvr"),
    ("EdgePilot", "foreign", "edgepilot"), ("AppRiver", "foreign", "appriver"), ("Evalanche", "foreign", "scnem"),
    ("Rubicon", "foreign", "rubicon.eu"),
]
KNOWN_DOMESTIC_HOSTS = """
    abxsec.com swiss-egov.cloud sui-inter.net ch-dns.net cyon.net seppmail.cloud swisscom.com privasphere.com
    tinext.com cloudrexx.com mailomat.cloud comp-sys.net engadin.cloud ti-informatique.com assolo.net moresi.com
    infomaniak naveum.services spamvor.com swisscenter.com seabix.cloud swizzonic.email tinext.net hosttech.eu
    mailpro.com tizoo.com
""".split()
DOMESTIC_TLDS = {"ch": [".ch", ".swiss"], "de": [".de"], "at": [".at"]}

# --- fixed values: quality checks ---------------------------------------------------------------------------------

SEVERITIES = ["ERROR", "WARNING", "INFO"]
FINDING_CATEGORIES = """
    logical_contradiction dane_inconsistency domain_mismatch mx_provider_mismatch scan_spf_mismatch
    missing_municipality contradictory_signals low_confidence mx_divergence missing_spf expected_security_missing
    unknown_classification invalid_scan
""".split()
MAX_PROVIDER_CHANGES_PCT = 5.0
CONFIDENCE_DROP = 20.0
MIN_HIGH_CONFIDENCE_SHARE = 0.90
MAX_ZERO_CONFIDENCE_SHARE = 0.05

# --- fixed values: protocol versions in ascending order -----------------------------------------------------------

TLS_VERSIONS = ["NO_STARTTLS", "SSLV2", "SSLV3", "TLS1", "TLS1_1", "TLS1_2", "TLS1_3"]
TLS_FLAGS = ["has_sslv2", "has_sslv3", "has_tls1", "has_tls1_1", "has_tls1_2", "has_tls1_3"]
TLS_LOG_KEYS = ["ssl2", "ssl3", "tls1", "tls1_1", "tls1_2", "tls1_3"]
