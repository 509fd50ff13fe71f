"""Thresholds, weights, word lists, lookup tables and texts.

Everything in this module is a value that results must reproduce exactly.  It
holds no logic; the column expressions that use it live in ``functions``.
"""

# --- Fixed values: thresholds per 100 g -------------------------------------

FAT_HIGH = 20.0
SUGARS_HIGH = 15.0
SUGARS_LOW = 5.0
SALT_HIGH = 1.5
SATURATED_FAT_HIGH = 5.0
PROTEIN_HIGH = 10.0
FIBER_HIGH = 6.0
CALORIES_HIGH = 400.0
NOVA_ULTRA_PROCESSED = 4
MANY_ADDITIVES = 5
GOOD_PROTEIN_DENSITY = 5.0

# --- Fixed values: grades and processing groups ------------------------------

GRADE_RANKS = {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
UNGRADED_RANK = 99

GRADE_DESCRIPTIONS = {
    "a": "excellent nutritional quality",
    "b": "good nutritional quality",
    "c": "moderate nutritional quality",
    "d": "poor nutritional quality",
    "e": "very poor nutritional quality",
}

NOVA_DESCRIPTIONS = {
    1: "unprocessed or minimally processed food",
    2: "processed culinary ingredient",
    3: "processed food",
    4: "ultra-processed food",
}

NOVA_SENTENCES = {
    1: "These foods are in their natural state with minimal processing.",
    2: "These are substances extracted from natural foods, used in cooking.",
    3: (
        "These products contain added salt, sugar, or other substances but are"
        " not significantly altered."
    ),
    4: (
        "Ultra-processed foods often contain additives, artificial flavors,"
        " emulsifiers, and preservatives. Regular consumption is associated with"
        " higher health risks."
    ),
}

# --- Fixed values: comparison of two products --------------------------------

METRIC_WEIGHTS = {
    "sugars": 0.30,
    "fat": 0.20,
    "salt": 0.15,
    "proteins": 0.20,
    "fiber": 0.15,
}
LOWER_IS_BETTER = {"sugars", "fat", "salt"}
MIN_KNOWN_METRICS = 2
GRADE_WEIGHT = 0.25
GRADE_STEPS = 4.0
NOVA_WEIGHT = 0.15
NOVA_STEPS = 3.0
SIMPLE_SCORE_PER_GRADE = 0.25
SIMPLE_CONFIDENCE = 75
CONFIDENCE_BASE = 50
CONFIDENCE_PER_SCORE = 35
CONFIDENCE_RANGE = (50, 98)
DISCOVERY_BASE = -0.05
DISCOVERY_PER_GRADE = 0.05
DISCOVERY_GRADE_FLOOR = -0.2
DISCOVERY_PER_NOVA = 0.03
DISCOVERY_NOVA_RANGE = (-0.1, 0.1)
DISCOVERY_CONFIDENCE = 60

# --- Fixed values: word lists ------------------------------------------------

CANDY_WORDS = ["candy", "candies", "sweets", "sweet", "confectionery", "gummies", "gummy"]
ORGANIC_WORDS = ["organic", "bio"]
FAIR_TRADE_WORDS = ["fair-trade", "fairtrade"]
CANDY_PAIRING_WORDS = ["fruit", "citrus", "yogurt", "water", "sparkling", "nuts"]
CANDY_BLOCKED_WORD = "tea"
CANDY_FILLERS = [
    "fresh fruit",
    "fresh citrus slices",
    "plain yogurt",
    "mixed nuts",
    "sparkling water",
    "water",
]
MAX_PAIRINGS = 5
MAX_REPLY_RISKS = 1
MAX_REPLY_POSITIVES = 2
PAIRING_ATTEMPTS = 2

# Characters removed from both ends of a text: all Unicode white space.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: category key -> pairings, in order of precedence on ties ---

DEFAULT_PAIRINGS = ["water", "fresh vegetables", "whole grain bread"]

CATEGORY_PAIRINGS = {
    "nut-butters": ["banana", "whole grain bread", "oatmeal", "apple slices", "celery"],
    "peanut-butter": ["banana", "whole grain bread", "oatmeal", "apple slices", "celery"],
    "jams": ["whole grain bread", "yogurt", "oatmeal", "rice cakes"],
    "bread": ["peanut butter", "avocado", "eggs", "cheese", "tomatoes"],
    "cereals": ["low-fat milk", "yogurt", "berries", "banana"],
    "yogurts": ["granola", "berries", "honey", "nuts"],
    "yogurt": ["granola", "berries", "honey", "nuts"],
    "greek-yogurt": ["granola", "berries", "honey", "nuts"],
    "fermented-milk": ["granola", "berries", "honey", "nuts"],
    "fermented-dairy": ["granola", "berries", "honey", "nuts"],
    "kefir": ["granola", "berries", "honey", "nuts"],
    "sour-cream": ["berries", "potatoes", "salmon", "dill"],
    "dairy": ["berries", "granola", "honey", "nuts"],
    "milk-products": ["cereals", "coffee", "tea", "berries"],
    "milk": ["cereals", "coffee", "tea", "berries"],
    "cheese": ["whole grain crackers", "grapes", "apple", "walnuts"],
    "olive-oils": ["pasta", "vegetables", "bread", "tomatoes", "garlic"],
    "olive-oil": ["pasta", "vegetables", "bread", "tomatoes", "garlic"],
    "extra-virgin-olive-oils": ["pasta", "vegetables", "bread", "tomatoes", "garlic"],
    "virgin-olive-oils": ["pasta", "vegetables", "bread", "tomatoes", "garlic"],
    "vegetable-oils": ["pasta", "vegetables", "bread", "potatoes", "rice"],
    "cooking-oils": ["pasta", "vegetables", "bread", "potatoes", "rice"],
    "oils": ["pasta", "vegetables", "bread", "potatoes", "rice"],
    "fats": ["vegetables", "bread", "potatoes", "pasta"],
    "legumes": ["rice", "onions", "garlic", "tomatoes", "spinach"],
    "legume-seeds": ["rice", "onions", "garlic", "tomatoes", "spinach"],
    "pulses": ["rice", "onions", "garlic", "tomatoes", "spinach"],
    "lentils": ["rice", "onions", "garlic", "tomatoes", "spinach"],
    "red-lentils": ["rice", "onions", "garlic", "tomatoes", "spinach"],
    "beans": ["rice", "corn", "tomatoes", "onions", "peppers"],
    "chickpeas": ["turmeric", "cumin", "olive oil", "tomatoes", "onions"],
    "legumes-and-their-products": ["rice", "onions", "garlic", "tomatoes", "spinach"],
    "chips": ["salsa", "guacamole", "hummus"],
    "chocolate": ["strawberries", "almonds", "red wine", "raspberries"],
    "biscuits": ["tea", "coffee", "milk"],
    "soups": ["whole grain bread", "crackers", "salad"],
    "pasta": ["tomato sauce", "vegetables", "lean meat", "olive oil"],
    "beverages": ["lemon", "ice", "mint"],
    "juices": ["sparkling water", "yogurt"],
}

# --- Fixed values: texts shown when nothing can be said ----------------------

SUMMARY_UNAVAILABLE = "LLM summary unavailable. Check API key, provider, or quota."
NUTRISCORE_UNAVAILABLE = "NutriScore explanation unavailable (LLM response not available)."
NOVA_UNAVAILABLE = "NOVA explanation unavailable (LLM response not available)."
NUTRISCORE_MISSING = "NutriScore is not available for this product."
NOVA_MISSING = "NOVA processing level is not available for this product."
DENSITY_MISSING = "Nutrient density information is not available."
NO_BARCODE_IN_URL = "Could not extract barcode from URL: "
BARCODE_NOT_FOUND = "Product not found for barcode: "

# --- Fixed values: prompt texts; $name marks a value filled in per product ----

PAIRINGS_PROMPT = """You are a food pairing expert. Suggest 5 foods commonly eaten with this specific product.

Product: $name
Category: $category$nutrients

Return ONLY a JSON response with this exact format (no markdown, no explanation):
{
  "pairings": ["food1", "food2", "food3", "food4", "food5"],
  "reasoning": "Brief explanation of why these foods pair well"
}

    Rules:
    1. Use category-specific, culturally realistic combinations for $category.
    2. Avoid generic snack lists that can apply to anything.
    3. Prefer foods commonly consumed together with $name in real meals/snacks.
    4. Keep each item short (1-3 words), no brand names, no duplicates.
    5. For candy/gummies/sweets categories, prefer realistic accompaniments (e.g., tea, fruit, yogurt), not random gourmet pairings.

Only return valid JSON, nothing else."""

SUMMARY_PROMPT = """Generate a brief, health-focused summary for this product:
Product: $name
Category: $category
NutriScore: $grade
NOVA Group: $nova

Summarize in 1-2 sentences focusing on nutritional quality and health implications.
Keep it factual and helpful for consumers."""

NUTRISCORE_PROMPT = """Explain the NutriScore grade for this product in 2 sentences.

Product: $name
NutriScore: $grade
Nutrients per 100g:
- Fat: ${fat}g
- Saturated Fat: ${saturated_fat}g
- Sugar: ${sugars}g
- Protein: ${proteins}g
- Fiber: ${fiber}g

Write a concise, helpful explanation of what this grade means and why this product received it. Focus on the key nutrients that influenced the score. Be specific and actionable.

Important nutrition guardrails:
- Do NOT call protein "high" unless protein >= 10g per 100g.
- Do NOT call fiber "high" unless fiber >= 6g per 100g.
- If sugar is low, prefer wording like "low sugar" rather than claiming high protein benefits.
- Avoid over-claiming healthiness for candy/confectionery products.
"""

NOVA_PROMPT = """Explain the NOVA processing level for this product in 2 sentences.

Product: $name
Category: $category
NOVA Group: $nova ($description)
Additives: $additives

Explain what this NOVA group means for this specific product type and why consumers should care. Be practical and balanced—avoid alarmism but be honest about processing concerns."""

INSIGHTS_PROMPT = """Analyze this food product and provide 1-2 additional contextual insights.

Product: $name
Category: $category
Nutrients (per 100g): $nutrients

Existing Analysis:
Risks: $risks
Positives: $positives

Provide ONLY a JSON response with this format:
{
  "enhanced_risks": ["One contextual risk if relevant, empty if none"],
  "enhanced_positives": ["One contextual positive insight"]
}

Rules:
- Keep insights brief (max 8 words each)
- Add context the existing analysis missed
- For olive oil: mention heart-healthy fats, not just "high fat"
- For lentils: mention plant-based protein quality
- Only add 0-2 items total, focus on most impactful insights
- Return valid JSON only"""

# --- Fixed values: texts of the indicators, in the order they are listed ------

RISK_TEXTS = {
    "fat": "High fat",
    "sugars": "High sugar",
    "salt": "High salt",
    "saturated_fat": "High saturated fat",
    "calories": "High calorie density",
    "nova": "Ultra-processed food (NOVA 4)",
    "additives": "Many additives (%d found)",
}

POSITIVE_TEXTS = {
    "protein": "High protein",
    "sugars": "Low sugar content",
    "fiber": "High fiber",
    "organic": "Organic label",
    "fair_trade": "Fair trade certified",
    "balanced": "Balanced fat, sugar, and salt levels",
    "nova_1": "Minimally processed (NOVA 1)",
    "nova_2": "Processed culinary ingredient (NOVA 2)",
    "grade": "Good NutriScore (%s)",
}
