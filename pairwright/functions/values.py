"""Labels, limits and wording that results must carry exactly.

Everything here is data, not logic.  ``BRAND`` stands for the name of the site
that shows the results; labels mention it through ``{brand}``.
"""

BRAND = "Pass"

# --- text ---------------------------------------------------------------------
EMPTY_TEXT_LABEL = "Chưa có nội dung"
WORD_UNIT = "từ"
PREVIEW_LENGTH = 30
PREVIEW_LABEL = "JD đang chọn"
DEFAULT_INDUSTRY = "Chuyên nghiệp"
DEFAULT_TONE = "Chuyên nghiệp"
DEFAULT_HINT = "Đang đợi câu hỏi..."
START_CUE = "Xin chào, tôi đã sẵn sàng tham gia buổi phỏng vấn."
APOLOGY = "⚠️ {brand} đang gặp sự cố một chút, hãy thử lại nhé..."
JSON_INSTRUCTION = (
    "\n\nYou must return a valid JSON object matching the exact requested schema."
)

# --- interview ----------------------------------------------------------------
DEFAULT_CURRENT_QUESTION = 1
DEFAULT_TOTAL_QUESTIONS = 5
INTERVIEW_LENGTHS = (3, 5, 7)
INITIAL_CONFIDENCE = 100
INITIAL_RELEVANCE = 100
INITIAL_VOCABULARY = "TỐT"
FILLERS = ("ờ", "ừm", "à", "thì là")

STRATEGY_INTRO = (
    "Ask an introductory/ice-breaker question to warm up the candidate. "
    "Keep it light but professional."
)
STRATEGY_FINAL = (
    "This is the FINAL question. Ask a wrap-up or high-level culture-fit question "
    "(e.g., career goals, team values, why this company)."
)
STRATEGY_DEEP = (
    "Deep dive into a specific technical or situational requirement from the JD. "
    "Challenge the candidate."
)

# --- enums --------------------------------------------------------------------
VOCABULARY_RATINGS = ("YẾU", "KHÁ", "TỐT", "XUẤT SẮC")
PRIORITIES = ("High", "Medium", "Low")
EVIDENCE_STRENGTHS = ("Strong", "Medium", "Weak", "Missing")
REPORT_CATEGORIES = (
    "Kỹ năng chuyên môn",
    "Giải quyết vấn đề",
    "Kiến thức ngành",
    "Giao tiếp",
    "Thái độ & Hành vi",
)

# --- score bands: (closed lower bound, label), best first, then the rest --------
REPORT_LABEL_BANDS = ((85, "Rất Tốt"), (65, "Khá Tốt"), (None, "Cần Cố Gắng"))
REPORT_COLOUR_BANDS = ((85, "green"), (65, "yellow"), (None, "orange"))
RESULT_LABEL_BANDS = (
    (85, "Khả năng {brand} cực cao 🚀"),
    (60, "Cơ hội tốt để {brand} ✅"),
    (None, "{brand} cần cải thiện thêm 📝"),
)
RESULT_MESSAGE_BANDS = ((75, "ready"), (None, "needs_work"))
RUBRIC_BANDS = (
    (85, "Excellent"),
    (65, "Good"),
    (40, "Average"),
    (None, "Below expectations"),
)
CONFIDENCE_BANDS = ((90, "90-100"), (50, "50-89"), (None, "0-49"))

# --- writing channels -----------------------------------------------------------
CHANNEL_LABELS = {
    "email": "Email ứng tuyển (Application Email)",
    "linkedin": "Tin nhắn LinkedIn cho nhà tuyển dụng",
    "zalo": "Tin nhắn Zalo ngắn gọn cho HR",
    "custom": "Nội dung tùy chỉnh theo yêu cầu người dùng",
}
CHANNEL_WORD_LIMITS = {"zalo": 150, "linkedin": 200}

# --- input rules: code and reason -----------------------------------------------
REJECT_NOT_PDF = (400, "not_pdf")
REJECT_UNPARSEABLE = (422, "unparseable")
REJECT_EMPTY_TEXT = (422, "empty_text")
REJECT_EMPTY_HISTORY = (422, "empty_history")
REJECT_EMPTY_SPEECH = (400, "empty_speech")
REJECT_CV_OR_JD = (422, "cv_or_jd_missing")

# --- list sizes asked of a response: field -> (min, max) --------------------------
LIST_SIZES = {
    "missing_keywords": (0, 5),
    "suggested_edits": (3, 5),
    "cv_strengths": (3, 4),
    "evidence_analysis": (4, 5),
    "sub_scores": (5, 5),
    "key_strengths": (2, 3),
    "areas_for_improvement": (2, 3),
    "top_topics_covered": (3, 5),
    "tips": (1, 2),
}

# --- word lists ------------------------------------------------------------------
STOP_WORDS = {
    "de": ("der", "die", "und", "ist", "nicht", "das", "den", "zu", "ein", "mit"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "was", "with"),
    "es": ("el", "los", "y", "que", "en", "una", "por", "las", "con", "para"),
    "fr": ("le", "et", "les", "des", "est", "une", "dans", "du", "pour", "qui"),
    "vi": ("và", "của", "là", "có", "cho", "với", "được", "không", "những", "trong"),
}
HEADINGS = (
    "summary", "skills", "experience", "education",
    "kinh nghiệm làm việc", "kỹ năng", "học vấn",
)
