"""Word lists, limits, patterns and texts that results depend on.

Callers may pass their own lists to the functions that use these.
"""

# Phrases that mark a question as a request for a summary.
SUMMARY_PHRASES = ["tóm tắt", "tổng kết", "summary", "summarize", "tóm tắt nội dung"]

# Question types in order of precedence, each with its phrases.
QUESTION_TYPES = {
    "comparison": ["so sánh", "khác nhau", "khác biệt", "so với", "thế nào"],
    "causal": ["tại sao", "vì sao", "nguyên nhân", "do", "bởi"],
    "procedural": ["cách", "bước", "quy trình", "làm thế nào", "thực hiện"],
    "definitional": ["là gì", "định nghĩa", "giải thích", "có nghĩa là"],
    "quantitative": ["bao nhiêu", "mấy", "số lượng", "phần trăm"],
}
DEFAULT_QUESTION_TYPE = "general"

# Reasoning words and list markers that earn a rerank bonus.
REASONING_WORDS = [
    "vì", "do", "nên", "kết quả", "nguyên nhân", "tại sao", "do đó", "vậy",
    "thế nên", "dẫn đến", "gây ra", "theo đó", "từ đó", "xuất phát từ", "dựa trên",
]
LIST_MARKERS = ["1.", "2.", "3.", "-", "•", "bước"]
REASONING_BONUS, DIGIT_BONUS, LIST_BONUS = 0.1, 0.05, 0.05

# Sentence and line ends tried, in this order, when a chunk end is moved.
BREAK_MARKERS = [". ", "! ", "? ", "\n\n", "\n"]
BREAK_LOOKAHEAD, BREAK_MIN_FILL = 50, 0.7
CHUNK_SIZE, CHUNK_OVERLAP = 380, 50

# Header and footer detection.
LINE_KEY_CHARS, MIN_REPEAT = 120, 3

# BM25 parameters.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# Retrieval and gating defaults.
TOP_K, CONTEXT_K, SUMMARY_CONTEXT_K = 10, 6, 12
HYBRID_ALPHA, MMR_LAMBDA, RECENCY_WEIGHT = 0.5, 0.6, 0.3
MIN_CONTEXT_PROB, MIN_DIRECT_PROB = 0.3, 0.2

# Near-duplicate thresholds.
MAX_HAMMING, VERSION_SIMILARITY, UPDATE_SIMILARITY = 10, 0.95, 0.80

# Upload limits and messages.
MAX_FILES, MAX_FILE_MB, MAX_QUESTION_CHARS = 5, 10, 1000
MSG_NOT_PDF = "File không phải PDF"
MSG_NO_SIGNATURE = "Tệp không phải PDF hợp lệ (thiếu chữ ký %PDF)"
MSG_TOO_LARGE = "File vượt quá {mb} MB"
MSG_TOO_MANY = "Tối đa {n} file / lần"
MSG_BLANK_QUESTION = "Query không được để trống"
MSG_LONG_QUESTION = "Query quá dài (tối đa 1000 ký tự)"
MSG_BAD_SESSION = "Session ID không hợp lệ"
MSG_NO_ANSWER = "Xin lỗi, không tìm thấy thông tin phù hợp trong tài liệu hiện có."

# Registration messages.
MSG_EXACT_DUPLICATE = "File '%s' đã tồn tại với nội dung giống hệt"
MSG_NEW = "Document hoàn toàn mới: %s"
MSG_VERSION = "Phát hiện version mới của '%s' (similarity: %.1f%%)"
MSG_SIMILAR = "Nội dung tương tự '%s' (%.1f%%)"
MSG_UPDATED = "Nội dung được cập nhật từ '%s' (%.1f%%)"

# Titles.
DEFAULT_CHAT_TITLE = "Cuộc trò chuyện"
SESSION_TITLE_PREFIX = "Phiên "
TITLE_CHARS = 60

# Citations such as [name.pdf: 3, 5-7].
CITATION_PATTERN = r"\[([^\[\]]+?\.pdf)\s*:\s*([^\]]+?)\]"
PAGE_RANGE_PATTERN = r"^(\d+)\s*[-–]\s*(\d+)$"

# Rate limits: endpoint -> (requests, seconds).
RATE_LIMITS = {"/upload": (5, 60), "/ingest": (3, 300), "/ask": (30, 60)}

# Context block format.
CONTEXT_HEADER = "[%d] %s:%s (độ phù hợp ≈ %.2f)"
CONTEXT_CHARS, SOURCE_CHARS, SOURCE_KEEP = 1200, 320, 300
MAX_OUTPUT_TOKENS = 1024

# Prompt texts.
SYSTEM_PROMPT = """Bạn là trợ lý RAG thông minh, trả lời bằng tiếng Việt dựa 100% trên NỘI DUNG TÀI LIỆU. Luôn suy luận LOGIC và THÔNG MINH dựa trên dẫn chứng từ tài liệu.
📋 QUY TRÌNH SUY LUẬN:
1. 🔍 Phân tích câu hỏi: Xác định ý chính, loại câu hỏi (thực tế, so sánh, quy trình, định nghĩa).
2. 🕵️‍♂️ Tìm kiếm dẫn chứng: So khớp thông tin từ tài liệu với câu hỏi.
3. 🧠 Suy luận logic: Kết nối thông tin, so sánh nếu cần, loại bỏ mâu thuẫn.
4. 🎯 Kết luận: Trả lời trực tiếp, rõ ràng, CHI TIẾT và CỤ THỂ.
📌 QUY TẮC:
• Không bịa đặt; nếu thiếu dữ liệu, trả lời: 'Xin lỗi, không tìm thấy thông tin phù hợp trong tài liệu hiện có.'
• Chỉ dùng thông tin từ tài liệu; không thêm kiến thức ngoài.
• Khi trích dẫn, ghi đúng tên file và số trang, ví dụ [tb741.pdf:3].
• Suy luận từng bước nếu câu hỏi phức tạp, nhưng giữ ngắn gọn.
• Trình bày bằng markdown rõ ràng, chuyên nghiệp và thân thiện.
• **LUÔN TRẢ LỜI CHI TIẾT VÀ CỤ THỂ**: Cung cấp đầy đủ thông tin, ví dụ thực tế, số liệu chính xác, bước thực hiện rõ ràng."""

REASONING_GUIDES = {
    "comparison": """Hãy suy luận để so sánh CHI TIẾT:
1. **Xác định đối tượng**: Liệt kê các thực thể cần so sánh với mô tả đầy đủ.
2. **Tìm điểm tương đồng**: Tìm và giải thích các đặc điểm chung một cách cụ thể.
3. **Tìm điểm khác biệt**: Xác định và phân tích sự khác nhau về đặc điểm, ưu/nhược điểm chi tiết.
4. **Kết luận**: Tổng hợp so sánh một cách logic với ví dụ cụ thể.""",
    "causal": """Hãy suy luận về nguyên nhân CHI TIẾT:
1. **Xác định hiện tượng**: Mô tả vấn đề hoặc kết quả với đầy đủ chi tiết.
2. **Tìm nguyên nhân trực tiếp**: Tìm và giải thích các yếu tố gây ra trực tiếp với ví dụ.
3. **Tìm nguyên nhân gián tiếp**: Xem xét và phân tích các yếu tố nền tảng chi tiết.
4. **Kết luận**: Giải thích mối quan hệ nhân quả với bằng chứng cụ thể.""",
    "procedural": """Hãy suy luận về quy trình CHI TIẾT:
1. **Xác định mục tiêu**: Mô tả kết quả mong muốn với đầy đủ chi tiết.
2. **Liệt kê bước thực hiện**: Tìm và mô tả các bước theo thứ tự logic với hướng dẫn cụ thể.
3. **Xác định điều kiện**: Lưu ý chi tiết các yêu cầu hoặc điều kiện tiên quyết.
4. **Kết luận**: Tóm tắt quy trình một cách có hệ thống với ví dụ thực tế.""",
    "definitional": """Hãy suy luận về định nghĩa CHI TIẾT:
1. **Xác định khái niệm**: Mô tả đối tượng cần định nghĩa với ngữ cảnh đầy đủ.
2. **Tìm đặc điểm chính**: Liệt kê và giải thích các thuộc tính quan trọng chi tiết.
3. **Tìm ví dụ**: Tìm và mô tả minh họa thực tế cụ thể.
4. **Kết luận**: Đưa ra định nghĩa rõ ràng, đầy đủ với các khía cạnh khác nhau.""",
    "quantitative": """Hãy suy luận về số lượng CHI TIẾT:
1. **Xác định chỉ số**: Mô tả dữ liệu cần tìm với ngữ cảnh đầy đủ.
2. **Tìm số liệu cụ thể**: Trích xuất và phân tích các con số từ tài liệu chi tiết.
3. **Xác minh tính chính xác**: Kiểm tra nguồn và ngữ cảnh với giải thích cụ thể.
4. **Kết luận**: Trình bày số liệu với đơn vị, ngữ cảnh và phân tích chi tiết.""",
    "general": """Hãy suy luận từng bước để trả lời CHI TIẾT và THÔNG MINH:
1. **Phân tích câu hỏi**: Xác định loại câu hỏi và thông tin cần thiết với phân tích sâu.
2. **Tìm kiếm dẫn chứng**: Trích xuất và phân tích thông tin liên quan từ tài liệu chi tiết.
3. **Suy luận logic**: Kết nối thông tin, so sánh nếu có nhiều nguồn, loại bỏ thông tin không liên quan với giải thích.
4. **Kết luận**: Trả lời trực tiếp, rõ ràng với đầy đủ chi tiết và bằng chứng.""",
}

SUMMARY_GUIDE = """Hãy suy luận thông minh để tóm tắt:
1. **Phân tích tổng thể**: Xác định chủ đề chính và mối liên hệ giữa các tài liệu.
2. **Trích xuất thông tin**: Lấy điểm chính, số liệu, quy trình từ mỗi nguồn.
3. **So sánh và tổng hợp**: Đối chiếu thông tin, loại bỏ trùng lặp, tạo bản đồ logic.
4. **Kết luận**: Tóm tắt cô đọng nhưng đầy đủ."""

SUMMARY_LAYOUT = """- **Tóm tắt tổng quát**: Nội dung chính của từng file với CHI TIẾT đầy đủ.
- **Điểm quan trọng**: Liệt kê các điểm chính, số liệu, quy trình CỤ THỂ và chi tiết.
- **So sánh nếu có**: Đối chiếu nội dung liên quan giữa các file một cách CHI TIẾT.
- **Kết luận**: Tóm tắt chung với logic rõ ràng và đầy đủ thông tin.
Sử dụng markdown, trích dẫn chính xác [tên_file.pdf:trang], đảm bảo logic và đầy đủ."""

ANSWER_LAYOUT = """- **Kết luận**: Câu trả lời trực tiếp, CHI TIẾT và CỤ THỂ (2-5 câu).
- **Dẫn chứng**: 2-4 điểm chính từ tài liệu với giải thích đầy đủ, kèm [tên_file.pdf:trang].
- **Phân tích** (nếu cần): Giải thích logic chi tiết, so sánh nếu có nhiều thông tin.
- **Khuyến nghị** (nếu phù hợp): Hành động tiếp theo hoặc lưu ý CỤ THỂ.
Sử dụng markdown, trích dẫn chính xác, đảm bảo logic và đầy đủ."""

CITATION_NOTE = """

**Lưu ý về trích dẫn:**
- Chỉ chèn trích dẫn [tên_file.pdf:trang] ở cuối đoạn hoặc bullet lớn nhất, không lặp lại cùng một trích dẫn nhiều lần liên tiếp trong cùng một đoạn hoặc danh sách.
- Nếu nhiều ý trong cùng đoạn/bullet cùng nguồn, chỉ cần citation ở cuối đoạn/bullet đó.
- Không chèn citation sau từng câu nhỏ nếu cùng nguồn.
"""

SECTION_CONTEXT = "=== THÔNG TIN TỪ TÀI LIỆU ==="
SECTION_QUESTION = "=== CÂU HỎI ==="
SECTION_GUIDE = "=== HƯỚNG DẪN SUY LUẬN ==="
SECTION_LAYOUT = "=== YÊU CẦU TRÌNH BÀY ==="
