"""Domain lists, words and patterns whose content decides results.

These are fixed values and must stay as they are.
"""

# fixed values
#: hosts that belong to a platform, never to the person or firm that links to them
PLATFORM_DOMAINS = (
    "tiktok.com", "instagram.com", "facebook.com", "fb.com", "x.com", "twitter.com", "t.me", "telegram.me",
    "youtube.com", "youtu.be", "twitch.tv", "kick.com", "dailymotion.com", "bsky.app", "mastodon.social",
    "threads.net", "skool.com", "medium.com", "substack.com", "patreon.com", "podia.com", "kajabi.com",
    "teachable.com", "thinkific.com", "gumroad.com", "ko-fi.com", "buymeacoffee.com", "tipeee.com", "base44.app",
    "linktr.ee", "bio.link", "carrd.co", "beacons.ai", "linkin.bio", "later.com", "lnk.bio", "milkshake.app",
    "bit.ly", "tinyurl.com", "rb.gy", "is.gd", "cutt.ly", "shorturl.at", "rebrand.ly", "ow.ly", "buff.ly", "t.co",
    "goo.gl", "dlvr.it", "ift.tt", "snip.ly", "lnkd.in", "amzn.to", "amzn.eu", "amzn.asia", "a.co", "wa.me",
    "discord.gg", "fb.me", "fb.watch", "envato.market", "amazon.com", "amazon.fr", "amazon.de", "amazon.co.uk",
    "etsy.com", "plus.google.com", "google.com", "forms.gle", "docs.google.com", "sites.google.com", "blogspot.com",
    "cal.com", "calendly.com", "tidycal.com", "savvycal.com", "typeform.com", "github.com", "github.io",
    "notion.site", "notion.so", "wordpress.com", "wix.com", "wixsite.com", "weebly.com", "squarespace.com",
    "shopify.com", "webflow.io", "vercel.app", "netlify.app", "fly.dev", "ovhcloud.com", "ovh.com", "ovh.net",
    "gandi.net", "ionos.fr", "ionos.com", "1and1.com", "1und1.de", "o2switch.fr", "infomaniak.com", "infomaniak.ch",
    "hostinger.com", "hostinger.fr", "scalahosting.com", "godaddy.com", "hostgator.com", "bluehost.com",
    "siteground.com", "dreamhost.com", "namecheap.com", "name.com", "a2hosting.com", "hostpapa.com", "kinsta.com",
    "wpengine.com", "cloudways.com", "planethoster.net", "planethoster.com", "lws.fr", "amen.fr", "nuxit.com",
    "hosteur.com", "ex2.com", "hetzner.com", "contabo.com", "scaleway.com", "digitalocean.com", "sessile.fr",
    "florajet.com", "interflora.fr", "aquarelle.com", "fleuristes-et-fleurs.com", "artisansfleuristesdefrance.com",
    "monfleuriste.fr", "lebouquetnantais.fr", "atom.com", "squadhelp.com", "sedo.com", "dan.com", "afternic.com",
    "hugedomains.com", "buydomains.com", "domainmarket.com", "brandbucket.com", "parkingcrew.net", "bodis.com",
    "above.com", "aaa.com", "savagex.com", "gobble.com", "nom-de-domaine.com", "votresite.com", "monsite.com",
)
#: placeholder domains
FAKE_DOMAINS = (
    "aaa.com", "bbb.com", "ccc.com", "xxx.com", "example.com", "example.fr", "example.org", "example.net",
    "exemple.com", "exemple.fr", "domain.com", "test.com", "email.com", "mail.com", "gobble.com", "savagex.com",
    "yourcompany.com", "yoursite.com", "yourbusiness.com", "votre-email.com", "votresite.com", "monsite.com",
    "nom-de-domaine.com", "adressemail.com", "adresse-email.com", "adresseemail.com", "votremail.com", "monemail.com",
    "emailaddress.com", "webname.com", "yourdomain.com", "your-domain.com", "yourwebsite.com", "mywebsite.com",
    "mysite.com", "placeholder.com", "votredomaine.com", "votre-domaine.com", "votredomaine.fr", "mondomaine.com",
    "mon-domaine.com", "mondomaine.fr", "xyz.com", "cm2c.net", "medicys.fr", "mediation-conso.fr",
    "cnpm-mediation-consommation.eu",
)
#: local parts that are never a mailbox
SUSPICIOUS_LOCAL_PARTS = (
    "only", "online", "more", "votre", "your", "no-reply", "noreply", "postmaster", "mailer-daemon",
)
#: first labels dropped from domains of three labels or more
FLATTEN_PREFIXES = (
    "links", "link", "linkin", "lnk", "bio", "social", "socials", "offre", "offres", "promo", "promos", "formation",
    "formations", "cours", "shop", "store", "boutique", "blog", "news", "page", "pages", "www",
)
#: top-level domains of more than three letters that are accepted
LONG_TLDS = (
    "info", "name", "mobi", "aero", "jobs", "coop", "asia", "post", "shop", "site", "club", "blog", "wine", "live",
    "life", "love", "care", "team", "city", "zone", "town", "fund", "work", "world", "store", "email", "earth",
    "group", "media", "house", "salon", "photo", "video", "money", "today", "click", "cloud", "space", "studio",
    "agency", "online", "center", "design", "travel", "photos", "coffee", "garden", "events", "social", "global",
    "digital", "marketing", "solutions", "services", "company", "business", "boutique", "immobilier", "restaurant",
    "technology", "photography", "enterprises", "consulting", "construction", "paris", "alsace", "corsica",
    "bretagne", "brussels", "museum",
)
#: infrastructure domains
TECHNICAL_SUFFIXES = (
    ".sentry.io", ".amazonses.com", ".sendgrid.net", ".mailgun.org", ".cloudfront.net", ".herokuapp.com",
    ".execute-api.amazonaws.com",
)
#: rank of generic local parts; any other ranks 10
EMAIL_PRIORITY = {
    "contact": 20,
    "sales": 25,
    "info": 30,
    "accueil": 35,
    "press": 70,
    "hello": 80,
    "support": 90,
    "help": 90,
    "support-technique": 95,
    "booking": 100,
    "noreply": 999,
    "no-reply": 999,
    "donotreply": 999,
}
#: purely social hosts
SOCIAL_DOMAINS = (
    "instagram.com", "instagr.am", "twitter.com", "x.com", "t.co", "facebook.com", "fb.com", "fb.me",
    "m.facebook.com", "tiktok.com", "vm.tiktok.com", "youtube.com", "youtu.be", "m.youtube.com", "twitch.tv",
    "m.twitch.tv", "reddit.com", "redd.it", "discord.gg", "discord.com", "github.com", "linkedin.com", "snapchat.com",
    "snap.com", "pinterest.com", "pinterest.fr", "vimeo.com", "soundcloud.com", "spotify.com", "open.spotify.com",
    "deezer.com", "music.apple.com", "threads.net", "bluesky.app", "bsky.app", "mastodon.social", "telegram.me",
    "t.me", "whatsapp.com", "wa.me", "kick.com",
)
#: patterns of commercial links
COMMERCIAL_URLS = (
    r"amzn\.to/", r"amazon\.[a-z.]{2,6}/(?:dp|gp/product|exec/obidos)/", r"awin1\.com", r"shareasale\.com",
    r"impact\.com", r"clickbank\.net", r"effiliation\.com", r"linktr\.ee/", r"beacons\.ai/", r"stan\.store/",
    r"snipfeed\.co/", r"komi\.io/", r"bio\.link/", r"shopify\.com", r"shop\.[\w-]+\.", r"\.myshopify\.com",
    r"etsy\.com/shop/", r"teespring\.com/", r"redbubble\.com/", r"spreadshirt\.", r"teepublic\.com", r"fanjoy\.co",
    r"gumroad\.com/", r"ko-fi\.com/", r"patreon\.com/", r"onlyfans\.com/", r"buymeacoffee\.com", r"tipeee\.com",
    r"fansly\.com", r"substack\.com", r"teachable\.com", r"podia\.com", r"thinkific\.com", r"systeme\.io",
    r"learnybox\.com", r"\bbit\.ly/", r"\btinyurl\.com/", r"\bcutt\.ly/",
)
#: words that show a business, in reporting order
COMMERCIAL_WORDS = (
    "boutique", "ma boutique", "notre boutique", "ma marque", "marque déposée", "code promo", "code reduc",
    "code réduction", "partenariat", "partenariats", "partenaire", "collab payée", "collab rémunérée",
    "collaboration payée", "affilié", "affiliation", "lien affilié", "liens affiliés", "sponsorisé", "sponsorisée",
    "sponsor", "sponsors", "sponsoring", "lien en bio", "lien dans la bio", "liens en bio", "mes produits",
    "ma collection", "ma sélection", "mes recommandations", "merch", "merchandising", "achetez", "commander",
    "commande", "commandez", "réduction", "promo", "promo en cours", "promotion", "ebook", "e-book",
    "livre numérique", "formation payante", "ma formation", "mes formations", "mon cours", "mes cours", "consulting",
    "consultant", "coaching individuel", "coaching personnalisé", "abonnement payant", "abonnement premium",
    "soutien", "soutenir", "soutenez", "ma masterclass", "masterclass payante", "produit phare", "best seller",
    "vente", "à vendre", "en vente", "site web", "mon site", "mon site web", "newsletter", "ma newsletter",
    "contact pro", "contact professionnel", "shop", "my shop", "store", "my store", "online store", "use code",
    "discount code", "promo code", "coupon", "sponsored by", "sponsored content", "this video is sponsored",
    "affiliate", "affiliate link", "affiliate links", "ad partner", "brand partner", "brand partnership",
    "link in bio", "my merch", "merch store", "buy now", "shop now", "order now", "pre-order", "preorder",
    "my course", "my book", "my ebook", "my masterclass", "my workshop", "support me", "tip jar", "donate",
    "join my patreon", "subscribe to my", "exclusive content", "members only", "subscribers only",
    "patreon supporters", "for business", "for collaborations", "for partnerships", "press kit", "media kit",
    "join the newsletter", "discord premium",
)
#: query words that hint at French
FRENCH_HINTS = (
    "le", "la", "les", "un", "une", "des", "et", "ou", "mais", "donc", "car", "pour", "avec", "sans", "dans", "sur",
    "sous", "vers", "chez", "depuis", "que", "qui", "quoi", "comment", "pourquoi", "boutique", "création", "creation",
    "vidéo", "video", "chaîne", "chaine", "français", "francais", "francaise", "francaises", "fr", "abonnés",
    "abonnes", "abonné", "abonne",
)
#: query words that hint at English
ENGLISH_HINTS = (
    "the", "and", "or", "but", "for", "with", "without", "from", "to", "channel", "video", "videos", "subscribe",
    "subscriber", "subscribers", "english", "uk", "us", "usa",
)
#: words that stay lower-case inside a display name
SMALL_WORDS = (
    "a", "à", "au", "aux", "de", "des", "du", "d", "la", "le", "les", "l", "et", "ou", "en", "dans", "sur", "sous",
    "par", "pour", "avec", "sans", "chez", "vers", "entre", "contre", "un", "une",
)
#: elided articles before an apostrophe
ELISIONS = (
    "d", "l", "j", "n", "m", "t", "s", "c", "qu", "jusqu", "lorsqu", "puisqu", "quoiqu",
)
#: labels of the 21 sections of the activity nomenclature
SECTION_LABELS = {
    'A': 'Agriculture, sylviculture et pêche',
    'B': 'Industries extractives',
    'C': 'Industrie manufacturière',
    'D': "Production et distribution d'électricité et de gaz",
    'E': "Production et distribution d'eau, assainissement, déchets",
    'F': 'Construction',
    'G': "Commerce ; réparation d'automobiles et de motocycles",
    'H': 'Transports et entreposage',
    'I': 'Hébergement et restauration',
    'J': 'Information et communication',
    'K': "Activités financières et d'assurance",
    'L': 'Activités immobilières',
    'M': 'Activités spécialisées, scientifiques et techniques',
    'N': 'Activités de services administratifs et de soutien',
    'O': 'Administration publique',
    'P': 'Enseignement',
    'Q': 'Santé humaine et action sociale',
    'R': 'Arts, spectacles et activités récréatives',
    'S': 'Autres activités de services',
    'T': "Activités des ménages en tant qu'employeurs",
    'U': 'Activités extra-territoriales',
}
#: hosts of pages that only list links; fixed values
HUB_DOMAINS = (
    "linktr.ee", "beacons.ai", "stan.store", "komi.io", "bio.link", "snipfeed.co", "campsite.bio", "lnk.bio",
    "carrd.co", "milkshake.app", "tap.bio", "later.com", "msha.ke", "shorby.com", "withkoji.com",
)
#: networks that links of a hub are not followed to; fixed values
HUB_SOCIAL_DOMAINS = (
    "instagram.com", "twitter.com", "x.com", "facebook.com", "tiktok.com", "youtube.com", "youtu.be", "twitch.tv",
    "reddit.com", "linkedin.com", "snapchat.com", "pinterest.com", "vimeo.com", "soundcloud.com", "spotify.com", "discord.gg",
    "discord.com", "telegram.me", "t.me", "wa.me", "whatsapp.com", "threads.net", "bsky.app",
)
#: paths of pages that tend to hold contact details; fixed values
PRIORITY_PATHS = (
    "/mentions-legales", "/legal", "/contact", "/contactez-nous", "/nous-contacter", "/about", "/a-propos", "/qui-sommes-nous",
    "/booking", "/reservation", "/devis", "/tarifs", "/prix", "/partenariat", "/partenariats", "/partner", "/partners",
    "/collab", "/collaboration", "/collaborer", "/business", "/pro", "/professionnel", "/equipe", "/team", "/notre-equipe",
    "/presse", "/media", "/medias", "/agence", "/agency", "/imprint", "/legal-notice", "/get-in-touch", "/work-with-us",
    "/hire-me", "/hire-us", "/services",
)
#: words of links to such pages; fixed values
PRIORITY_WORDS = (
    "mentions légales", "mentions legales", "mentions", "contact", "contactez", "nous écrire", "écrire", "à propos", "a propos", "about",
    "imprint", "legal", "booking", "réserver", "réservation", "devis", "partenariat", "partenariats", "partner", "collab",
    "business", "pro", "travailler avec", "équipe", "team", "presse", "media", "tarifs", "prix", "services", "hire", "work with",
)
#: trade rules in order: the first whose stems occur decides; fixed values
TRADE_RULES = (
    ("commerce", ("osteo", "kinesi", "kine", "reeduc")),
    ("artisan", ("tapiss",)),
    ("commerce", ("architecte d'interieur", "architecte interieur", "architecte d interieur", "decorateur", "decoratrice", "decoration d'interieur", "home staging")),
    ("artisan", ("piscin",)),
    ("commerce", ("chambre", "gite", "maison d'hote", "hotes")),
    ("commerce", ("auto-ecole", "auto ecole", "ecole de conduite", "permis")),
    ("artisan", ("lavage auto", "lavage automobile", "detailing", "car wash", "nettoyage auto", "lustrage")),
    ("commerce", ("food truck", "food-truck", "foodtruck", "food trailer", "camion pizza", "camion a pizza", "camion restaurant", "camion a burger", "street food")),
    ("commerce", ("dieteti", "nutrition")),
    ("commerce", ("salle de sport", "salle de fitness", "fitness", "crossfit", "cross-fit", "musculation", "club de sport")),
    ("commerce", ("salle de reception", "salle des fetes", "salle de fete", "domaine de mariage", "domaine de reception", "lieu de reception", "location de salle")),
    ("commerce", ("wedding", "organisateur de mariage", "organisation de mariage", "organisateur d'evenement", "organisation d'evenement", "organisateur d evenement", "organisation d evenement")),
    ("commerce", ("agent immobilier", "agence immobiliere", "mandataire immo", "negociateur immo", "immobilier", "immobiliere")),
    ("artisan", ("poele", "granul", "pellet", "pompe a chaleur", "aerotherm", "geotherm", "climatis", "photovolta", "panneau solaire", "energies renouvelab")),
    ("commerce", (r"\bdj\b", "disc jockey", "disc-jockey", "deejay", "sonorisation", "animation de soiree", "animation musicale")),
    ("artisan", ("demenag", "garde-meuble")),
    ("artisan", ("domoti", "alarme", "videosurveillance", "video surveillance", "videoprotection", "maison connectee")),
    ("commerce", ("diagnostiqueur", "diagnostic immobilier", "diagnostics immobiliers", "diagnostic immo", "dpe")),
    ("commerce", ("veterin",)),
    ("artisan", ("constructeur de maison", "constructeur maison", "maitre d'oeuvre", "maitre d oeuvre", "maison individuelle", "constructeur")),
    ("commerce", ("boucher", "boucherie", "charcuti")),
    ("commerce", ("bijou", "joaill", "orfevr", "horloger")),
    ("commerce", ("opticien", "optique", "lunetier", "lunetterie")),
    ("commerce", ("fromag", "cremerie", "cremier")),
    ("commerce", ("poissonn", "maree", "fruits de mer", "ecailler")),
    ("commerce", ("torref", "brulerie", "cafe de specialite", "barista")),
    ("commerce", ("microbrasserie", "micro-brasserie", "brasseur", "biere artisanale")),
    ("artisan", ("homme toutes mains", "toutes mains", "multiservice", "petits travaux", "petit travaux", "factotum", "bricol")),
    ("artisan", ("plomb", "chauffag", "electric", "peintr", "carrel", "faienc", "macon", "menuis", "ebenist", "charpent", "plaquist", "placo", "platr", "paysag", "jardin", "elagag", "espaces vert", "couvr", "serrur", "terrass", "renov", "batiment", "travaux", "artisan", "isolation", "garage", "mecanic", "carross", "vitrier", "metall", "ferronn", "facad", "ravalement", "cuisiniste", "store", "portail", "cloture", "etancheit", "demolition")),
    ("cabinet", ("avocat", "notaire", "huissier", "comptab", "medecin", "dentist", "dentaire", "kine", "osteo", "infirmier", "podolog", "orthophon", "psycholog", "psychiatr", "veterin", "cabinet", "architect", "geometre", "assurance", "courtier", "therapeut", "expert")),
    ("commerce", ("fleur", "patiss", "boulang", "chocolat", "confis", "cake", "restaur", "pizz", "brasser", "creper", "bistro", "traiteur", "snack", "kebab", "cafe", "coiff", "barbier", "esthet", "beaut", "ongle", "manucur", "maquill", "institut", "cils", "massag", "spa", "bien-etre", "bien etre", "sophro", "naturopath", "reflexo", "yoga", "hypno", "coach", "photograph", "videast", "tatou", "tattoo", "piercing", "toilettag", "canin", "pension", "dressage", "boutique", "magasin", "epicerie", "boucher", "primeur", "caviste", "opticien", "bijou", "pressing", "hotel", "gite", "fromager", "poissonn")),
)
#: statuses in rank order; an opt-out or bounce absorbs all others; fixed values
STATUSES = ("new", "qualified", "contacted", "replied", "won", "lost", "refused")
ABSORBING = ("bounced", "unsubscribed")
#: fields that a column may feed, in order, with the header forms that name them; fixed values
HEADER_HINTS = {
    "name": ("nom", "name", "nomcomplet", "fullname", "contact", "prenomnom", "prenom", "firstname", "nomprenom", "intitule"),
    "legal_name": ("raisonsociale", "societe", "entreprise", "company", "companyname", "denomination", "etablissement"),
    "emails": ("email", "mail", "emails", "mails", "courriel", "adressemail", "adresseemail", "emailaddress", "emailpro"),
    "phones": ("tel", "telephone", "phone", "phonenumber", "mobile", "portable", "telmobile", "telpro", "numero", "numerotelephone"),
    "website": ("site", "siteweb", "website", "url", "web", "lien", "internet", "siteinternet"),
    "address": ("adresse", "address", "rue", "voie", "addressline"),
    "city": ("ville", "city", "town", "commune", "localite"),
    "postal_code": ("cp", "codepostal", "postal", "zip", "zipcode", "postalcode"),
    "country": ("pays", "country", "nation"),
    "industry": ("secteur", "industry", "industrie", "metier", "domaine", "activite", "categorie", "type", "naf"),
    "siren": ("siren", "siret", "rcs", "numerosiren", "numerosiret"),
    "notes": ("notes", "note", "commentaire", "commentaires", "remarque", "remarques", "observation"),
}
#: local parts of addresses that stand for a firm and not for a person; fixed values
GENERIC_LOCAL = ("contact", "info", "hello", "bonjour", "accueil", "commercial", "secretariat", "administration", "admin", "direction", "office", "mail", "courrier", "reception", "boutique", "magasin")

#: accounts that stand for a community: patterns of name, handle and address; fixed values
GROUP_NAME = r"(?i)^\s*r/"
GROUP_HANDLE = r"(?i)^\s*/?r/"
GROUP_URL = r"(?is)^(?!.*reddit\.com/u(?:ser)?/).*reddit\.com/r/"

#: how HTML writes an apostrophe, and a blank before French punctuation; fixed values
APOSTROPHES = ("'", "’", "&rsquo;", "&#39;")
BLANKS = (" ", "&nbsp;")
FRENCH_MARKS = ":;!?»"
