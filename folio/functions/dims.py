"""Reference tables of the corpus: titles, exclusions, topics and phrases."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Topic:
    """A subject, its query phrase, the phrases that name it, and the titles that treat it."""

    name: str
    phrase: str
    aliases: tuple[str, ...]
    titles: tuple[str, ...]


# All tables below must be as they are for right results.

CHAPTER_TITLES: tuple[str, ...] = (  # number 1 and on
    "Nutrition for the 21st Century - Integrating Nutrigenetics, Nutrigenomics, and Microbiomics",
    "Development of Gastrointestinal Function",
    "Breastfeeding",
    "Formula Feeding of Term Infants",
    "Nutritional Needs of the Preterm Infant",
    "Complementary Feeding",
    "Feeding the Child",
    "Adolescent Nutrition",
    "Nutrition in School, Preschool, and Child Care",
    "Pediatric Global Nutrition",
    "Nutritional Aspects of Vegetarian Diets",
    "Sports Nutrition",
    "Fast Foods, Organic Foods, Fad Diets, and Herbs, Herbals, and Botanicals",
    "Energy",
    "Protein",
    "Carbohydrate and Dietary Fiber",
    "Fats and Fatty Acids",
    "Calcium, Phosphorus, and Magnesium",
    "Iron",
    "Trace Elements",
    "Vitamins",
    "Parenteral Nutrition",
    "Enteral Feeding for Nutritional Support",
    "Assessment of Nutritional Status",
    "Pediatric Feeding and Swallowing Disorders",
    "Malnutrition, Undernutrition, and Failure to Thrive",
    "Chronic Diarrheal Disease",
    "Oral Therapy for Acute Diarrhea",
    "Inborn Errors of Metabolism",
    "Nutrition Therapy for Children and Adolescents With Type 1 and Type 2 Diabetes Mellitus",
    "Hypoglycemia in Infants and Children",
    "Dyslipidemia",
    "Pediatric Obesity",
    "Food Allergy",
    "Nutrition and Immunity",
    "Nutritional Support of Children With Developmental Disabilities",
    "Nutrition of Children Who Are Critically Ill",
    "Eating Disorders in Children and Adolescents",
    "Nutrition for Children With Sickle Cell Disease and Thalassemia",
    "Nutrition in Renal Disease",
    "Nutritional Management of Children With Cancer",
    "Nutrition in the Management of Chronic Autoimmune Inflammatory Bowel Diseases in Children",
    "Liver Disease",
    "Cardiac Disease",
    "Nutrition in Children With Short Bowel Syndrome",
    "Nutrition in Cystic Fibrosis",
    "The Ketogenic Diet",
    "Diet, Nutrition, and Oral Health",
    "Preventing Food Insecurity - Available Community Nutrition Programs",
    "Federal Regulation of Foods, Infant Formulas, and Food Labeling",
    "Food Safety: Infectious Disease",
    "Food Safety: Pesticides, Industrial Chemicals, Toxins, Preservatives, Irradiation, and Food Biotechnology",
)

SECTION_TITLES: dict[str, str] = {
    "1.1": "Child Growth",
    "1.2": "Nutritional Assessment",
    "1.2.1": "Clinical Evaluation and Anthropometry",
    "1.2.2": "Dietary History and Dietary Assessment",
    "1.2.3": "Technical Measurements of Body Composition",
    "1.2.4": "Use of Laboratory Measurements in Nutritional Assessment",
    "1.3": "Physiology of Nutrition",
    "1.3.1": "Nutrient Intake Values: Concepts and Applications",
    "1.3.2": "Energy Requirements of Infants, Children, and Adolescents",
    "1.3.3": "Protein",
    "1.3.4": "Digestible and Non-Digestible Carbohydrates",
    "1.3.5": "Dietary Lipid Intake",
    "1.3.6": "Fluid and Electrolytes",
    "1.4": "Micronutrient Needs in Children and Adolescents",
    "1.4.1": "Physical Activity, Health, and Nutrition",
    "1.4.2": "Early Nutrition Impact on Long-Term Health",
    "1.4.3": "Food Safety",
    "1.4.5": "Gut Microbiota Development in Infants and Children",
    "1.4.7": "Nutrition, Brain Development, and Mental Health",
    "2.6": "Dietary Needs and Challenges in Toddlers and Young Children",
    "2.7": "Adolescent Nutrition: Issues and Actions",
    "2.9": "Vegetarian and Vegan Diets",
    "3.2": "Iron: Nutritional Deficiency and Excess",
    "3.3": "Micronutrient Deficiencies",
    "3.4": "Enteral Nutrition Support",
    "3.5": "Parenteral Nutrition Support",
    "3.6": "Management of Child and Adolescent Obesity",
    "3.7": "Acute and Prolonged Childhood Diarrhea",
    "3.11": "Celiac Disease",
    "3.12": "Food Intolerance and Allergy",
    "3.13": "Constipation and the Efficacy of Fluid, Fat, Fibers, and Prebiotics",
    "3.18": "Nutrition in Children with Diabetes Mellitus",
    "3.22": "Nutrition in Cystic Fibrosis",
    "3.24": "Nutritional Management in Children with Chronic Kidney Disease",
    "3.25": "Diet in Children with Malignant Disease",
    "5.2": "Reference Nutrient Intakes of Infants, Children, and Adolescents",
}

EXCLUDED_CHAPTERS = (2, 3, 4, 5, 6)
EXCLUDED_SECTIONS = ("2.1", "2.2", "2.3", "2.4", "2.5", "2.6", "3.15", "3.16", "5.3")
INFANT_MARKERS = ("breastfeeding", "formula feeding", "complementary feeding", "preterm infant", "feeding my baby")

TOPICS: tuple[Topic, ...] = (
    Topic(
        "school_meals",
        "school meals breakfast lunch snacks vending packed lunch child care nutrition",
        ("school meal", "school lunch", "school breakfast", "packed lunch", "وجبة مدرسية", "وجبات المدرسة", "فطار المدرسة",),
        ("Nutrition in School, Preschool, and Child Care",),
    ),
    Topic(
        "adolescent",
        "adolescent nutrition puberty growth nutrient requirements",
        ("adolescent", "teen", "puberty", "مراهق", "مراهقة", "البلوغ",),
        ("Adolescent Nutrition", "Adolescent Nutrition: Issues and Actions",),
    ),
    Topic(
        "sports",
        "sports nutrition young athlete hydration carbohydrate recovery energy drinks",
        ("sports", "athlete", "exercise", "رياضة", "رياضي", "تمرين",),
        ("Sports Nutrition", "Physical Activity, Health, and Nutrition",),
    ),
    Topic(
        "vegetarian",
        "vegetarian vegan child adolescent protein vitamin B12 iron zinc calcium vitamin D",
        ("vegetarian", "vegan", "vegetarian diet", "vegan diet", "نباتي", "نباتية", "النباتي", "النباتية", "نباتي صرف", "النباتي الصرف", "نباتيون", "النباتيون", "نباتيون صرف", "النباتيون الصرف", "نظام نباتي", "حمية نباتية",),
        ("Nutritional Aspects of Vegetarian Diets", "Vegetarian and Vegan Diets",),
    ),
    Topic(
        "energy",
        "energy requirements total energy expenditure growth physical activity school-age children",
        ("energy", "calorie", "caloric", "طاقة", "سعرات",),
        ("Energy", "Energy Requirements of Infants, Children, and Adolescents",),
    ),
    Topic(
        "protein",
        "protein requirements quality amino acids food sources growing children",
        ("protein", "amino acid", "بروتين", "احماض امينية",),
        ("Protein",),
    ),
    Topic(
        "carbohydrate",
        "carbohydrate dietary fiber school-age children constipation glycemic",
        ("carbohydrate", "fiber", "fibre", "كربوهيدرات", "ألياف", "الياف",),
        ("Carbohydrate and Dietary Fiber", "Digestible and Non-Digestible Carbohydrates",),
    ),
    Topic(
        "fat",
        "dietary fats fatty acids omega-3 child adolescent nutrition",
        ("fat", "fatty acid", "lipid", "omega", "دهون", "احماض دهنية",),
        ("Fats and Fatty Acids", "Dietary Lipid Intake",),
    ),
    Topic(
        "iron",
        "iron deficiency anemia cognition school performance adolescent girls",
        ("iron", "anemia", "anaemia", "حديد", "انيميا", "فقر الدم",),
        ("Iron", "Iron: Nutritional Deficiency and Excess",),
    ),
    Topic(
        "bone",
        "calcium phosphorus magnesium vitamin D bone mineral adolescence peak bone mass",
        ("calcium", "phosphorus", "magnesium", "bone", "كالسيوم", "فوسفور", "مغنيسيوم", "عظام",),
        ("Calcium, Phosphorus, and Magnesium", "Micronutrient Needs in Children and Adolescents",),
    ),
    Topic(
        "obesity",
        "pediatric obesity assessment staged family-based weight management physical activity screen time",
        ("obesity", "overweight", "weight management", "سمنة", "زيادة الوزن",),
        ("Pediatric Obesity", "Management of Child and Adolescent Obesity",),
    ),
    Topic(
        "diabetes",
        "pediatric diabetes nutrition therapy carbohydrate counting meal planning exercise hypoglycemia",
        ("diabetes", "diabetic", "سكر", "سكري",),
        ("Nutrition Therapy for Children and Adolescents With Type 1 and Type 2 Diabetes Mellitus", "Nutrition in Children with Diabetes Mellitus",),
    ),
    Topic(
        "food_allergy",
        "food allergy elimination diet nutrient adequacy school meals cross-contact allergen safety",
        ("food allergy", "allergen", "allergens", "elimination diet", "cross-contact", "حساسية الطعام", "حساسية طعام", "حساسية غذائية", "مسبب الحساسية", "مسببات الحساسية", "حمية استبعاد", "نظام استبعاد", "استبعاد غذائي", "تلامس عرضي", "التلامس العرضي",),
        ("Food Allergy", "Food Intolerance and Allergy",),
    ),
    Topic(
        "assessment",
        "pediatric nutritional assessment growth chart BMI anthropometry dietary history laboratory",
        ("nutritional assessment", "growth chart", "BMI", "anthropometry", "تقييم غذائي", "مؤشر كتلة الجسم",),
        ("Assessment of Nutritional Status", "Nutritional Assessment",),
    ),
    Topic(
        "eating_disorder",
        "eating disorders adolescents warning signs nutritional rehabilitation anorexia bulimia",
        ("eating disorder", "anorexia", "bulimia", "اضطراب الاكل", "فقدان الشهية",),
        ("Eating Disorders in Children and Adolescents",),
    ),
    Topic(
        "dyslipidemia",
        "pediatric dyslipidemia dietary management cholesterol saturated fat fiber",
        ("dyslipidemia", "cholesterol", "lipid disorder", "دهون الدم", "كوليسترول",),
        ("Dyslipidemia",),
    ),
    Topic(
        "oral_health",
        "diet nutrition oral health dental caries sugary drinks children adolescents",
        ("oral health", "dental caries", "tooth decay", "تسوس", "صحة الفم", "مشروبات سكرية",),
        ("Diet, Nutrition, and Oral Health",),
    ),
    Topic(
        "food_safety",
        "school packed lunch food safety cross contamination temperature infectious disease",
        ("food safety", "cross contamination", "packed lunch safety", "lunch box safety", "safe temperature", "safe temperatures", "سلامة الغذاء", "سلامة الوجبات", "سلامة اللانش بوكس", "لانش بوكس", "تلوث تبادلي", "التلوث التبادلي", "درجات حرارة آمنة", "درجة حرارة آمنة",),
        ("Food Safety: Infectious Disease", "Food Safety",),
    ),
    Topic(
        "food_insecurity",
        "food insecurity screening school breakfast lunch nutrition assistance programs",
        ("food insecurity", "school meal program", "انعدام الامن الغذائي", "نقص الغذاء",),
        ("Preventing Food Insecurity", "Nutrition in School, Preschool, and Child Care",),
    ),
    Topic(
        "food_labeling",
        "food labeling allergens nutrition facts school-age children family food choices",
        ("food label", "nutrition label", "allergen label", "ingredient label", "بطاقة غذائية", "بطاقة الغذاء", "بطاقة الطعام", "بطاقة المكونات", "ملصق غذائي", "ملصق الطعام", "البيانات الغذائية",),
        ("Federal Regulation of Foods", "Food Allergy",),
    ),
    Topic(
        "fast_food",
        "fast food fad diets herbs botanicals adolescents nutritional risks",
        ("fast food", "fad diet", "herbal", "وجبات سريعة", "حمية رائجة", "اعشاب",),
        ("Fast Foods, Organic Foods, Fad Diets",),
    ),
)

SPECIAL_PHRASES: dict[str, tuple[str, ...]] = {
    "school_meals": ("breakfast", "breakfast skipping", "school breakfast", "lunch box", "lunchbox", "school meal", "school meals", "لانش بوكس", "وجبات خفيفة", "وجبة خفيفة", "وجبات المدرسة", "تخطي الفطور"),
    "bone": ("calcium", "vitamin d", "bone mass", "bone mineral", "كالسيوم", "فيتامين د", "كتلة عظمية", "كتلة العظام", "بناء العظام"),
    "sports": ("athlete", "athletes", "adolescent athlete", "adolescent athletes", "caffeine", "energy drink", "energy drinks", "كافيين", "مشروبات الطاقة", "رياضي", "الرياضي"),
    "assessment": ("dietary history", "diet history", "growth chart", "growth charts", "body mass index", "bmi", "anthropometry", "anthropometric", "nutritional assessment", "تاريخ الغذاء", "مخططات النمو", "مؤشر كتلة الجسم", "القياسات الجسمية", "تقييم الحالة الغذائية"),
}
ENERGY_DRINKS = ("energy drink", "energy drinks", "مشروب طاقة", "مشروبات الطاقة")
ANCHOR_TOPICS = ("bone", "sports", "assessment")

STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "child", "children", "during", "for", "from", "how", "in", "is", "of", "on", "or", "pediatric", "school", "the", "to", "what", "which", "with")
BROAD_MARKERS = ("nutritional needs", "nutrition needs", "healthy diet", "balanced diet", "what should", "what does a child need", "food groups", "daily diet", "الاحتياجات الغذائية", "العناصر الغذائية", "ياكل ايه", "يأكل إيه", "غذاء صحي", "نظام غذائي")
BROAD_EXPANSION = " balanced pediatric diet food groups protein-rich foods vegetables fruit whole grains and energy foods dairy and calcium-rich foods healthy fats water hydration iron zinc vitamins minerals practical meals"
REFUSALS = ("provide the question", "input is not in english", "could you please", "please provide", "it seems like", "i cannot", "i can't", "as an ai")
