"""Word lists, domains, signatures and defaults that results depend on."""

# Words in a URL that raise its risk.
SUSPICIOUS_WORDS = (
    "account", "admin", "amazon", "apple", "bank", "binance", "bonus", "coinbase", "confirm", "credential", "delivery", "dhl",
    "dropbox", "facebook", "gift", "google", "invoice", "login", "metamask", "microsoft", "netflix", "office", "onedrive", "outlook",
    "paypal", "password", "recover", "secure", "security", "signin", "suspended", "unlock", "update", "usps", "verify", "wallet",
)
# Names that are often imitated.
BRAND_WORDS = (
    "adobe", "airdrop", "apple", "binance", "coinbase", "docusign", "ledger", "metamask", "microsoft", "office", "onedrive", "paypal",
    "seed", "treezo", "trezo", "trezor", "trezr", "wallet",
)
# Platforms where anyone can host.
HOSTING_DOMAINS = (
    "blogspot.com", "firebaseapp.com", "github.io", "glitch.me", "netlify.app", "pages.dev", "replit.app", "sites.google.com",
    "vercel.app", "web.app", "weebly.com", "wixsite.com", "wixstudio.com", "wordpress.com",
)
# URL shorteners.
SHORTENERS = ("bit.ly", "cutt.ly", "is.gd", "ow.ly", "rebrand.ly", "shorturl.at", "t.co", "tiny.cc", "tinyurl.com")
# Top-level domains of raised risk.
RISKY_TLDS = ("cam", "cfd", "click", "club", "cyou", "fit", "gq", "icu", "live", "ml", "mom", "quest", "rest", "sbs", "shop", "tk", "top", "work", "xyz", "zip")
# Query parameters that redirect.
REDIRECT_PARAMS = ("continue", "dest", "destination", "next", "redirect", "redirect_uri", "return", "returnurl", "target", "url")
# Words in a page that raise its risk, and those of a login form.
HTML_WORDS = ("confirm", "credential", "login", "password", "recover", "secure", "security", "signin", "suspended", "unlock", "update", "verify", "wallet")
LOGIN_WORDS = ("login", "signin", "password", "account")
# What error pages say, in order of precedence.
ERROR_SIGNATURES = (
    "this site can't be reached", "this page isn’t working", "this page isn't working", "err_name_not_resolved", "err_connection_",
    "installation error", "service worker gateway", "an error occurred while trying to install the service worker", "access denied",
    "error 404", "404 not found", "domain is parked", "domain parking", "verify you are human",
    "checking if the site connection is secure", "just a moment", "this account has been suspended", "account suspended",
    "domain suspended",
)
# Label synonyms.
LEGITIMATE = ("0", "legitimate", "legit", "good", "benign", "safe")
PHISHING = ("1", "phishing", "phish", "bad", "malicious")
# Attributes and tags whose values become tokens.
SIGNAL_ATTRS = ("action", "alt", "aria-label", "content", "href", "id", "name", "placeholder", "property", "src", "type", "value")
SIGNAL_TAGS = ("a", "button", "form", "iframe", "img", "input", "label", "meta", "select", "textarea", "title")
# IPv4 networks that aren't global.
LOCAL_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
# IPv6 networks that aren't global.
LOCAL_NETWORKS_V6 = (
    "0:0:0:0:0:0:0:0/128", "0:0:0:0:0:0:0:1/128", "64:ff9b:1::/48", "100:0:0:0::/64", "2001:0::/23", "2001:db8::/32", "2002::/16", "3fff::/20",
    "fc00::/7", "fe80::/10",
)
# Addresses inside these networks that are global: 192.0.0.9 and 192.0.0.10 as numbers, and IPv6 networks.
GLOBAL_INSIDE = (3221225481, 3221225482)
GLOBAL_INSIDE_V6 = ("2001:1:0:0:0:0:0:1/128", "2001:1:0:0:0:0:0:2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
# Models in their order, with what they read.
MODELS = (("url_cnn", "url"), ("url_lstm", "url"), ("html_cnn", "html"), ("screenshot_cnn", "screenshot"), ("dual_branch_cnn", "url+html"), ("tri_branch_cnn", "url+html+screenshot"))
