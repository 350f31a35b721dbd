"""Word lists and patterns of the Arabic rule pack, as plain text."""

from __future__ import annotations

# Results depend on these words, patterns and names.
FIRST_NAMES = """
أحمد محمد علي حسن حسين خالد سعد سعود سعيد فهد بندر ناصر عبدالله عبدالرحمن عبدالعزيز إبراهيم يوسف يعقوب
موسى عيسى هارون زيد عمر عثمان أبوبكر حمزة طارق وليد سلمان سامي ماجد نواف تركي مشاري راشد صالح
ياسر وائل هشام كريم أمين محمود مصطفى أيمن أنس أسامة بسام جمال حازم خليل رامي رياض زياد سامر
شاكر صبري ضياء طلال عادل عامر غسان فادي فارس نوح إسماعيل إسحاق يحيى بلال أديب سلطان
فيصل حمد نايف مهنا رزان غازي سرحان كمال
فاطمة خديجة عائشة زينب مريم سارة هند نورة ريم منى سلمى ليلى هدى نوال نجلاء سمر رنا دانة
روان لمى غادة أمل إيمان آلاء أسماء بشرى تهاني حنان خولة دلال ذكرى رحاب زهراء سعاد شيماء صفاء
نهى وفاء نجوى أروى بثينة جواهر ربى شذى عبير أبو أم ابن بنت بن
""".split()
KINSHIP = "أبو أم ابن بنت بن".split()
FAMILY_NAMES = """
السعدي القحطاني الغامدي الحربي العتيبي الشهري الزهراني العنزي الدوسري الشمري المطيري الرشيد الراجحي العثيمين
الفايز الصباح الثاني المالكي العقيل الفهد المنصور الحسيني العمري البكر النصر الفيصل السديري السهيلي
""".split()
LOCATIONS = """
السعودية المملكة الإمارات الكويت البحرين قطر عُمان اليمن العراق الأردن سوريا لبنان فلسطين مصر ليبيا
تونس الجزائر المغرب السودان موريتانيا الصومال
الرياض جدة مكة المدينة الدمام الخبر الظهران الأحساء الطائف بريدة تبوك حائل أبها نجران جازان ينبع
الجبيل القصيم الخرج الجوف
دبي أبوظبي الشارقة العين الدوحة المنامة مسقط القاهرة الإسكندرية الجيزة أسوان الأقصر دمشق حلب
بيروت عمّان بغداد الموصل البصرة صنعاء عدن
المطار المسجد المستشفى الجامعة المدرسة السوق الميناء المكتب الشارع الطريق الميدان الحي المركز
""".split() + ["حفر الباطن"]
LOCATION_INDICATORS = "في إلى من عند بـ ب نحو صوب تجاه".split()
ORGANIZATIONS = "أرامكو سابك stc موبايلي زين الراجحي الأهلي سامبا نيوم روشن علم تكامل أكوا معادن المراعي العثيم الدانوب".split() + ["البنك السعودي", "بن داود"]
#: Words that begin an organisation's name, which runs to the end of the text.
ORGANIZATION_HEADS = "شركة مؤسسة وزارة هيئة بنك جامعة كلية مجموعة".split()
HOSPITAL = "مستشفى"
DAYS = "السبت الأحد الاثنين الإثنين الثلاثاء الأربعاء الخميس الجمعة".split()
MONTHS = """محرم|صفر|ربيع الأول|ربيع الثاني|ربيع الآخر|جمادى الأولى|جمادى الآخرة|رجب|شعبان|رمضان|شوال|ذو القعدة|ذو الحجة|
يناير|فبراير|مارس|أبريل|مايو|يونيو|يوليو|أغسطس|سبتمبر|أكتوبر|نوفمبر|ديسمبر|كانون الثاني|شباط|آذار|نيسان|أيار|حزيران|تموز|
آب|أيلول|تشرين الأول|تشرين الثاني|كانون الأول""".replace("\n", "").split("|")
HONORIFICS = "السيد الأستاذ الدكتور الشيخ المهندس الأخ الأخت الأمير الأميرة الملك الملكة الوزير النائب الرئيس المدير العم الخال الجد الجدة د. أ. م. أ.د. السيدة الآنسة".split()
STOPWORDS = """
في على إلى من عن مع بين حتى إذ إذا أن أنّ لكن ثم أو أم إما بل غير سوى خلا عدا حاشا حيث كي لكي ولكن و ف ل ب ك
هو هي هم هن أنت أنتم أنتن أنا نحن أنتما هما هذا هذه هؤلاء ذلك تلك أولئك الذي التي اللذان اللتان الذين اللواتي اللائي اللاتي
كان كانت يكون تكون أصبح أمسى بات ظل صار ليس ليست لست لسنا لستم لسن
قال قالت قلت يقول تقول أقول نعم لا بلى كلا ربما لعل قد قط أبداً دائماً كل بعض أكثر أقل إن أنه إنه أي أية أيها
ما ماذا متى أين كيف لماذا كم ذاك واحد اثنان ثلاث أربع خمس
شيء أشياء أمر أمور حال أحوال وقت أوقات يوم أيام شهر أشهر سنة سنوات ساعة ساعات
""".split()
ACTIONS = {
    "send": "أرسل بعث ابعث ارسل يرسل ترسل أبعث أرسلت بعثت",
    "receive": "استلم استلمت تسلم تسلّم استلام وصل وصلت وصلني",
    "meet": "اجتمع التقى قابل قابلت لقي لقاء اجتماع تقابل",
    "call": "اتصل كلّم حدّث تكلم اتصلت مكالمة نادى",
    "go": "ذهب ذهبت راح رحت توجه توجّه سافر وصل",
    "arrive": "وصل وصلت حضر حضرت بلغ بلغت قدم",
    "deliver": "سلّم سلم أوصل أوصلت ناول أعطى أعطيت",
    "agree": "اتفق اتفقت وافق وافقت موافق اتفاق",
    "confirm": "أكّد أكد أكدت تأكيد أثبت أثبتت",
    "cancel": "ألغى ألغت ألغيت إلغاء أوقف أوقفت",
    "postpone": "أجّل أجل أجلت تأجيل أخّر أخر",
    "buy": "اشترى اشتريت ابتاع شراء بضاعة",
    "sell": "باع بعت بيع بيعت",
    "pay": "دفع دفعت سدّد سدد تسديد حوّل حول",
    "request": "طلب طلبت أراد أردت يطلب تطلب",
    "promise": "وعد وعدت تعهّد تعهد التزم",
    "warn": "حذّر حذر حذرت نبّه أنذر",
    "decide": "قرّر قرر قررت قرار",
}
#: Prefixes that a verb may carry as one word with it.
VERB_PREFIXES = ["", "س", "و", "ف", "وس", "فس", "ل", "ولا", "فلا"]
STEM_SUFFIXES = "ها هم هن ون ين ات ان تين تان".split()
STEM_ARTICLES = "وال بال كال فال ال".split()
OBJECT_STOPS = "في إلى من على عند مع قبل بعد عبر نحو".split()
PATTERNS = [
    ("EMAIL", 0.99, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("PHONE", 0.95, r"(?:\+|00)\p{Nd}{1,4}[-\s]?\p{Nd}{2,4}[-\s]?\p{Nd}{3,8}"),
    ("PHONE", 0.95, r"05\p{Nd}{8}"),
    ("PHONE", 0.95, r"\p{Nd}{3}[-\s]\p{Nd}{3}[-\s]\p{Nd}{4}"),
    ("MONEY", 0.90, r"\p{Nd}+(?:[.,]\p{Nd}+)?\s*(?:ريال|ر\.س|درهم|دينار|جنيه|دولار|يورو)"),
    ("MONEY", 0.90, r"(?:ريال|ر\.س|درهم|دينار|جنيه|دولار|يورو)\s*\p{Nd}+(?:[.,]\p{Nd}+)?"),
    ("MONEY", 0.90, r"\p{Nd}+(?:[.,]\p{Nd}+)?\s*(?:مليون|مليار|ألف)\s*(?:ريال|درهم|دولار)?"),
    ("DATE", 0.80, r"اليوم|أمس|غداً?|البارحة"),
    ("DATE", 0.80, r"الأسبوع\s+(?:الماضي|القادم|الحالي|المقبل)|الشهر\s+(?:الماضي|القادم|الحالي|المقبل)|السنة\s+(?:الماضية|القادمة|الحالية|المقبلة)"),
    ("DATE", 0.80, r"(?:بعد|قبل|منذ)\s+(?:ساعة|ساعتين|يوم|يومين|أسبوع|شهر|سنة)"),
    ("DATE", 0.95, r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("TIME", 0.85, r"الساعة\s+(?:الواحدة|الثانية|الثالثة|الرابعة|الخامسة|السادسة|السابعة|الثامنة|التاسعة|العاشرة|الحادية\s+عشرة|الثانية\s+عشرة)"),
    ("TIME", 0.85, r"الساعة\s+\p{Nd}{1,2}(?::\p{Nd}{2})?"),
    ("TIME", 0.85, r"\p{Nd}{1,2}:\p{Nd}{2}\s*(?:ص|م|صباحاً|مساءً|ظهراً)?"),
    ("TIME", 0.85, r"(?:صباحاً|مساءً|ظهراً|عصراً|ليلاً|فجراً)|منتصف\s+(?:الليل|النهار)"),
    ("PERSON", 0.92, r"(?U)(?:أبو|أم)\s+\S+?(?=[\s.,؛،!?؟]|$)"),
]
NODE_TYPES = {"PERSON": "Person", "LOCATION": "Location", "ORGANIZATION": "Organization", "DATE": "Date", "TIME": "Time", "MONEY": "Money", "KEYWORD": "Keyword", "PHONE": "Phone", "EMAIL": "Email"}
RELATION_EDGES = {
    "meet_at": "MET_AT", "meet_with": "MET_WITH", "meet_on": "OCCURRED_ON", "agree_with": "AGREED_WITH", "agree_on": "OCCURRED_ON", "agree_at": "OCCURRED_AT",
    "call_with": "CALLED", "call_on": "OCCURRED_ON", "send_to": "SENT_TO", "send_at": "OCCURRED_AT", "send_on": "OCCURRED_ON", "send_with": "SENT_TO",
    "receive_from": "RECEIVED_FROM", "receive_at": "OCCURRED_AT", "receive_on": "OCCURRED_ON", "go_to": "WENT_TO", "go_at": "WENT_TO", "go_on": "OCCURRED_ON",
    "arrive_at": "ARRIVED_AT", "arrive_on": "OCCURRED_ON", "deliver_to": "SENT_TO", "deliver_at": "OCCURRED_AT",
}
UNKNOWN_SPEAKER = "غير معروف"


def verbs() -> dict[str, str]:
    """Verb to action; of a verb listed twice the later action holds."""
    return {v: action for action, words in ACTIONS.items() for v in words.split()}


def terms() -> list[tuple[str, str, float, int]]:
    """(term, type, confidence, words) of the dictionary rules; words of kinship are parts of names, not names."""
    kinds = (("PERSON", 0.85, [n for n in FIRST_NAMES if n not in KINSHIP]), ("LOCATION", 0.75, LOCATIONS), ("ORGANIZATION", 0.90, ORGANIZATIONS), ("DATE", 0.85, DAYS + MONTHS))
    return [(t, kind, conf, len(t.split())) for kind, conf, words in kinds for t in words]
