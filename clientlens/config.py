"""Fixed values of the census: word lists and thresholds, all replaceable."""

from __future__ import annotations

# Words of User-Agents.
ENGINES = ["gecko", "applewebkit", "trident", "presto", "khtml"]
AUTOMATION = [
    "spider", "crawl", "slurp", "scrapy", "python-requests", "httpx", "aiohttp", "libwww", "java/", "go-http", "okhttp",
    "node-fetch", "axios", "curl", "wget", "headless", "phantomjs", "selenium", "facebookexternalhit", "feedfetcher",
    "monitor", "uptime", "pingdom",
]
HEADLESS = ["headless", "phantomjs", "slimerjs", "electron", "puppeteer", "playwright"]
LIBRARIES = ["python-requests", "httpx", "aiohttp", "scrapy", "libwww", "java/", "go-http", "okhttp", "node-fetch", "axios", "curl", "wget"]
FEED_TERMS = ["feed", "rss", "atom", "podcast", "subscriber"]
FEED_READERS = [
    "NetNewsWire", "Feedly", "Inoreader", "NewsBlur", "Miniflux", "FreshRSS", "Newsboat", "newsbeuter", "Liferea", "Akregator",
    "Tiny Tiny", "theoldreader", "Feedbin", "CommaFeed", "BazQux", "NewsFlash", "RSS Guard", "Reeder", "Feedspot", "Blogtrottr",
    "Feedrabbit", "Kindle4RSS", "UniversalFeedParser", "SimplePie", "feedparser", "rss2email", "FeedBurner", "Unread",
    "News Explorer", "ReadYou", "Elfeed", "rawdog", "Instapaper", "Protopage", "Yarr", "Arsse", "newsraft", "wp.com feedbot",
    "Windows-RSS-Platform", "NextCloud-News", "davefeedread", "gofeed", "rss-parser", "Tapestry", "Micro.blog", "Vienna",
    "hypertexting", "Foragd", "BubblesBot", "Selfoss", "Skyreader", "feedspool", "SurfaceFeedPoller", "Lumen/", "FeedFetcher-Google",
]
APPS = ["CFNetwork", "com.apple.", "NetworkingExtension", "dart:io", "AFNetworking", "Alamofire", "Ktor client"]
MONITORS = ["uptimerobot", "pingdom", "statuscake", "site24x7", "newrelic", "datadog", "nagios", "zabbix", "monitor", "healthcheck", "hetrixtools", "updown", "cron-job"]
SCANNERS = [
    "sqlmap", "nmap", "nikto", "nuclei", "masscan", "wpscan", "zgrab", "l9scan", "BlackVeil-Security-Scanner", "SecurityScanner",
    "AliyunSecBot", "TLM-Audit-Scanner", "CMS-Checker", "acunetix", "nessus", "openvas", "netsparker", "qualysguard",
    "arachni", "wfuzz", "feroxbuster", "gobuster", "dirbuster", "commix", "wapiti", "whatweb", "joomscan", "droopescan", "xsstrike",
    "dotdotpwn", "l9explore", "l9tcpid",
]
# Requests.
STATIC_MEDIA = [
    "text/css", "text/javascript", "application/javascript", "application/json", "application/pdf", "application/wasm",
    "image/", "font/", "audio/", "video/", "application/font", "application/x-font",
]
STATIC_EXT = [
    "css", "js", "mjs", "png", "jpg", "jpeg", "gif", "svg", "webp", "avif", "ico", "bmp", "woff", "woff2", "ttf", "eot", "otf",
    "map", "mp4", "webm", "mp3", "ogg", "wav", "pdf",
]
PAGE_MEDIA = ["text/html", "application/xhtml+xml"]
PAGE_EXT = ["html", "htm", "xhtml", "php", "asp", "aspx", "jsp", "shtml", "cfm"]
CHROME_ASSETS = ["favicon", "apple-touch-icon"]
TRAVERSAL = ["../", "..%2f", "%2e%2e", "..\\", "%00", "/etc/passwd", "/proc/self"]
EVASION = ["%252e", "%252f", "%255c", "%c0%ae", "%c0%af", "%u002e"]
EXOTIC_METHODS = ["PUT", "DELETE", "PROPFIND", "PROPPATCH", "CONNECT", "TRACE", "PATCH", "MKCOL"]
ALWAYS_PROBE = [
    "/.env", "/.git/", "/.svn/", "/.aws/", "/.ssh/", "/.htpasswd", "/.htaccess", "/id_rsa", "/credentials", "/config.php",
    "/configuration.php", "/wp-config.php", "/database.yml", "/.DS_Store", "/.git-credentials", "/.npmrc", "/.s3cfg", "/.pgpass",
    "/.netrc", "/.my.cnf", "/.dockerenv", "/.kube/", "/.terraform/", "/secrets.json", "/secrets.yml", "/app/etc/local.xml",
    "/sites/default/settings.php", "/shell", "/cmd.php", "/eval-stdin.php", "/vendor/phpunit", "/boaform", "/HNAP1", "/setup.cgi",
    "/tmUnblock.cgi", "/currentsetting.htm", "/etc/passwd", "/proc/self",
]
PROBE_IF_ABSENT = [
    "/wp-login.php", "/wp-admin", "/wp-content", "/xmlrpc.php", "/administrator/", "/joomla", "/drupal", "/phpmyadmin", "/phpMyAdmin",
    "/pma/", "/myadmin", "/adminer.php", "/dbadmin", "/cgi-bin/", "/actuator", "/solr/", "/struts", "/jenkins", "/.well-known/openid",
    "/telerik", "/owa/", "/autodiscover",
]
SUBMIT = ["wp-comments-post", "comment", "xmlrpc", "wp-login", "/login", "signin", "register", "contact", "sendmail"]
# Fixed values.
#: Declared agents (category, token), in order of precedence; a table may be given instead.
AGENTS = [
    ("ads", "AdsBot-Google"), ("ads", "Mediapartners-Google"), ("ai_user", "ChatGPT-User"), ("ai_user", "Claude-User"),
    ("ai_user", "Perplexity-User"), ("web_tool", "W3C_Validator"), ("web_tool", "Chrome-Lighthouse"), ("search_engine", "Googlebot"),
    ("search_engine", "bingbot"), ("search_engine", "DuckDuckBot"), ("search_engine", "YandexBot"), ("search_engine", "Baiduspider"),
    ("search_engine", "Applebot"), ("social_preview", "facebookexternalhit"), ("social_preview", "Twitterbot"),
    ("social_preview", "Slackbot"), ("social_preview", "Discordbot"), ("archiver", "archive.org_bot"), ("archiver", "ia_archiver"),
    ("ai_crawler", "GPTBot"), ("ai_crawler", "ClaudeBot"), ("ai_crawler", "CCBot"), ("ai_crawler", "PerplexityBot"),
    ("ai_crawler", "Bytespider"), ("ai_crawler", "Amazonbot"), ("seo_marketing", "AhrefsBot"), ("seo_marketing", "SemrushBot"),
    ("seo_marketing", "MJ12bot"), ("seo_marketing", "DotBot"), ("data_harvester", "DataForSeoBot"), ("data_harvester", "ZoominfoBot"),
    ("vuln_scanner", "CensysInspect"), ("monitor", "UptimeRobot"), ("monitor", "Pingdom"),
]
# Fixed values.
#: Kinds, first wins a tie.
KINDS = [
    "impersonator", "ads", "ai_user", "web_tool", "search_engine", "social_preview", "archiver", "ai_crawler", "seo_marketing",
    "data_harvester", "vuln_scanner", "spam_bot", "feed_reader", "monitor", "browser", "app", "scraper", "crawler",
    "spoofed_browser", "automation", "unknown",
]
KNOWN_CRAWLERS = KINDS[1:10]
# Fixed values.
#: Browser releases: (family, major, date of that release, days a major lasts).
RELEASES = [("chrome", 120, "2023-12-06", 30), ("firefox", 121, "2023-12-19", 30), ("safari", 17, "2023-09-18", 365)]
#: Buckets of the histogram of gaps: ten a decade over ten decades, and both ends.
GAP_BUCKETS = 102
COLOAD_SECONDS, EXACT_DELTAS, TARGET_CAP, BUCKETS, GRID_SECONDS = 10, 256, 256, 40, 300
UNKNOWN_THRESHOLD, MAX_PER_KIND, RESIDENT_CAP = 0.45, 1000, 50_000
#: Matrix: share of a kind that earns a network a column, if it holds this share of all and so many requests.
BREAKOUT_SHARE, GUARD_SHARE, GUARD_REQUESTS = 0.10, 0.0001, 100
IMPOSSIBLE_SHARE, IMPOSSIBLE_HITS = 0.2, 2
#: Tags that confirm who a client is, and those that only tell of its requests.
VERIFIED_TAGS = ["dns-verified", "ip-verified", "wba-verified"]
OBSERVATIONAL = [
    "checked-robots", "polls-feeds", "has-cache", "lacks-cache", "loads-assets", "no-assets", "follows-links", "cold", "singleton",
    "uses-HEAD", "post-heavy", "long-session", "high-rate", "high-bytes", "wide-breadth", "metronomic", "bursty", "steady",
]
RESIDENTIAL, OTHER_HOSTING = "Residential / unknown", "Other"
# Fixed values.
#: Outlier tags: margin, least pool, least requests, and floors by metric.
MARGIN, LEAST_POOL, LEAST_REQUESTS = 3.0, 30, 5
FLOORS = {"rate": 60.0, "bytes": 5_000_000.0, "breadth": 0.5, "session": 86_400.0}
