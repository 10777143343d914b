"""Fixed values of the rules; every operator also takes them as parameters."""

# Domains that are a social profile and no web site.
SOCIAL_DOMAINS = ("instagram.com", "facebook.com", "fb.com")

# Shop platform signatures, first match wins, case-sensitive.
PLATFORM_SIGNATURES = (
    ("Shopify", "cdn.shopify.com"),
    ("WooCommerce", "woocommerce"),
    ("PrestaShop", "prestashop"),
    ("Magento", "mage/"),
    ("Magento", "Magento"),
    ("Squarespace", "static.squarespace.com"),
    ("Wix", "static.wixstatic.com"),
    ("Webflow", "webflow.com"),
)
# A vendor's own signatures rank after this platform (see signatures_with).
_OWN_AFTER = "PrestaShop"

# Words of a shopping cart, any letter case.
CART_WORDS = (
    "add-to-cart",
    "addtocart",
    "/checkout",
    "/cart",
    "/carrito",
    "añadir al carrito",
    "agregar al carrito",
    "data-product-id",
)
UNKNOWN_PLATFORM = "Desconocida"

# What an address must not be.
FILE_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico",
    "css", "js", "pdf", "woff", "woff2", "ttf", "eot",
)
BLOCKED_LOCALS = ("sentry", "noreply", "no-reply", "do-not-reply")
BLOCKED_DOMAINS = ("sentry.io", "ingest.sentry.io", "sentry-next.wixpress.com")

# Paths of the social network that are no profile.
RESERVED_HANDLES = (
    "p", "reel", "reels", "tv", "stories", "explore", "accounts",
    "direct", "about", "developer", "web", "_u", "legal", "sitemap",
    "press", "api", "download", "mobile", "challenge", "emails",
    "session", "ajax", "oauth", "privacy", "terms", "help", "popular",
)
# Title words of other networks.
OTHER_NETWORKS = (
    "tiktok", "threads", "mentions", "facebook", "twitter", "youtube", "pinterest", "linkedin",
)
# Words too common to tell one business from another.
GENERIC_WORDS = (
    "moda", "modas", "tienda", "tiendas", "calzado", "calzados", "zapateria",
    "zapaterias", "boutique", "ropa", "shop", "store", "sport", "sports",
    "deporte", "deportes", "kids", "ninos", "infantil", "outlet", "the",
    "los", "las", "del", "de", "y", "la", "el", "and", "mujer", "hombre",
)
# Further words a handle may carry.
HANDLE_FILLER = (
    *GENERIC_WORDS,
    "spain", "es", "esp", "oficial", "official", "online", "by", "galicia", "asturias",
)

# Category stems and their place types, first match wins.
CATEGORY_STEMS = (
    ("zapater", "shoe_store"),
    ("calzado", "shoe_store"),
    ("ropa", "clothing_store"),
    ("moda", "clothing_store"),
    ("niñ", "clothing_store"),
    ("deport", "sporting_goods_store"),
    ("restaurant", "restaurant"),
    ("bar", "bar"),
    ("cafeter", "cafe"),
    ("café", "cafe"),
    ("cafe", "cafe"),
    ("farmacia", "pharmacy"),
    ("supermercado", "supermarket"),
    ("peluquer", "hair_salon"),
    ("ferreter", "hardware_store"),
    ("librer", "book_store"),
    ("joyer", "jewelry_store"),
    ("mueble", "furniture_store"),
    ("gimnasio", "gym"),
    ("hotel", "lodging"),
    ("panader", "bakery"),
    ("florister", "florist"),
)

# Score bands, points and tiers.
WEIGHTS = {
    "criterios": {
        "distancia_eci": {
            "bandas": [
                {"min_km": 45, "max_km": 85, "puntos": 20, "etiqueta": "óptimo (45–85km)"},
                {"min_km": 30, "max_km": 45, "puntos": 15, "etiqueta": "cercano (30–45km)"},
                {"min_km": 85, "max_km": 120, "puntos": 15, "etiqueta": "lejano (85–120km)"},
                {"min_km": 0, "max_km": 30, "puntos": 10, "etiqueta": "sombra ECI (<30km)"},
                {"min_km": 120, "max_km": 99999, "puntos": 10, "etiqueta": "aislado (>120km)"},
            ]
        },
        "poblacion_municipio": {
            "bandas": [
                {"min": 15000, "max": 50000, "puntos": 15, "etiqueta": "cabecera ideal (15–50k)"},
                {"min": 50001, "max": 150000, "puntos": 12, "etiqueta": "ciudad media (50–150k)"},
                {"min": 10000, "max": 14999, "puntos": 8, "etiqueta": "cabecera pequeña (10–15k)"},
                {"min": 0, "max": 9999, "puntos": 3, "etiqueta": "rural (<10k)"},
                {"min": 150001, "max": 99999999, "puntos": 10, "etiqueta": "gran urbe (>150k)"},
            ]
        },
        "num_tiendas": {
            "bandas": [
                {"min": 3, "max": 7, "puntos": 30, "etiqueta": "micro-cadena ideal (3–7 locales)"},
                {"min": 8, "max": 999, "puntos": 30, "etiqueta": "CENTRAL / FRANQUICIA (>7 locales)"},
                {"min": 2, "max": 2, "puntos": 15, "etiqueta": "duo (2 locales)"},
                {"min": 1, "max": 1, "puntos": 5, "etiqueta": "tienda única"},
            ]
        },
        "madurez_digital": {
            "valores": {
                "ecommerce_funcional": 10,
                "solo_redes_sociales": 15,
                "sin_presencia": 5,
            },
            "por_tecnologia": {
                "WooCommerce": 20,
                "PrestaShop": 20,
                "Magento": 15,
                "Shopify": 8,
            },
        },
        "encaje_avatar": {
            "valores": {"encaje_claro": 15, "encaje_parcial": 7, "no_encaja": 0},
        },
    },
    "tramos_prioridad": [
        {"id": "P1", "min_puntos": 75, "etiqueta": "Prioridad 1 — Visita o contacto comercial inmediato"},
        {"id": "P2", "min_puntos": 55, "etiqueta": "Prioridad 2 — Prospección planificada"},
        {"id": "P3", "min_puntos": 35, "etiqueta": "Prioridad 3 — Seguimiento / Nutrición"},
        {"id": "P4", "min_puntos": 0, "etiqueta": "Prioridad 4 — Bajo interés"},
    ],
}

# Customer avatars.
AVATARS = [
    {
        "id": 1,
        "nombre": "El Señorío Comarcal",
        "criterios": {
            "poblacion_municipio": [15000, 50000],
            "distancia_eci_km": [45, 90],
            "num_tiendas": [3, 7],
            "ecommerce_requerido": False,
        },
        "encaje_parcial_si_cumple_n": 3,
    },
    {
        "id": 2,
        "nombre": "La Hegemonía Interior",
        "criterios": {
            "poblacion_municipio": [55000, 130000],
            "distancia_eci_km": [85, 9999],
            "num_tiendas": [2, 6],
            "ecommerce_requerido": False,
        },
        "encaje_parcial_si_cumple_n": 3,
    },
    {
        "id": 3,
        "nombre": "La Aguja Urbana",
        "criterios": {
            "poblacion_municipio": [200000, 99999999],
            "distancia_eci_km": [0, 15],
            "num_tiendas": [1, 2],
            "ecommerce_requerido": True,
        },
        "encaje_parcial_si_cumple_n": 2,
    },
    {
        "id": 4,
        "nombre": "Nodos de Volumen / Redes",
        "criterios": {
            "poblacion_municipio": [0, 99999999],
            "distancia_eci_km": [0, 99999],
            "num_tiendas": [8, 999],
            "ecommerce_requerido": False,
        },
        "encaje_parcial_si_cumple_n": 3,
    },
]

# Request prices by tier.
PRICING = {
    "text_search": {
        "essentials": {"free_per_month": 10000, "first_paid_band": None},
        "pro": {
            "free_per_month": 5000,
            "first_paid_band": {"from": 5001, "to": 100000, "rate_per_1000": 32.00},
        },
        "enterprise": {
            "free_per_month": 1000,
            "first_paid_band": {"from": 1001, "to": 100000, "rate_per_1000": 35.00},
        },
    }
}

# Budget of paid searches.
FIRST_SEARCH_COST = 0.002
BUDGET_SLACK = 1e-9
EXTRA_MARGIN = 0.004

# Search grid.
CELL_DEGREES = 0.01
MIN_CELL_DEGREES = 0.002
START_ZOOM = 14
MAX_ZOOM = 16
RESULTS_PER_CELL = 120

# Paging of the places search.
RESULTS_PER_PAGE = 20
MAX_PAGES = 3

# Fixed value: smallest town in the list built from saved pages.
MIN_TOWN_POPULATION = 5000


def signatures_with(own_platform: str, own_needles: list[str]) -> list[tuple[str, str]]:
    """Platform signatures with a vendor's own ones at their place in the order."""
    out = []
    for name, needle in PLATFORM_SIGNATURES:
        out.append((name, needle))
        if name == _OWN_AFTER:
            out += [(own_platform, own) for own in own_needles]
    return out
