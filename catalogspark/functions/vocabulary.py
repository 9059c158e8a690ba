"""Dictionaries, patterns and word lists of the catalog's rules (all must equal the published ones)."""

EMPTY = ("", "-", "null", "없음")

# Code dictionaries.
CYCLES = {"수시": "IRREGULAR", "일간": "DAILY", "주간": "WEEKLY", "월간": "MONTHLY", "분기": "QUARTERLY", "반기": "SEMIANNUAL", "연간": "ANNUAL", "-": "UNSPECIFIED", "": "UNSPECIFIED"}
LICENSES = {
    "이용허락범위 제한 없음": "NO_RESTRICTION",
    "공공저작물_출처표시": "KOGL_BY",
    "공공저작물_출처표시 + 상업적 이용금지": "KOGL_BY_NC",
    "공공저작물_출처표시 + 변경금지": "KOGL_BY_ND",
    "공공저작물_출처표시 + 상업적 이용금지 + 변경금지": "KOGL_BY_NC_ND",
    "저작자표시-비영리-동일조건변경허락": "CC_BY_NC_SA",
    "-": "UNSPECIFIED",
    "": "UNSPECIFIED",
}
FEES = {"무료": "FREE", "유료": "PAID", "-": "UNSPECIFIED", "": "UNSPECIFIED"}
FRESH_DAYS = {"DAILY": 7, "WEEKLY": 30, "MONTHLY": 60, "QUARTERLY": 180, "SEMIANNUAL": 365, "ANNUAL": 540}

#: header -> internal name, in header order
SNAPSHOT_COLUMNS = {
    "목록키": "list_key", "목록유형": "list_type", "목록명": "title", "파일데이터명": "file_data_name", "분류체계": "theme_raw",
    "제공기관코드": "org_code", "제공기관": "org_name", "관리 부서명": "dept_name", "관리부서 전화번호": "dept_phone_raw",
    "보유근거": "retention_basis", "수집방법": "collection_method", "업데이트 주기": "update_cycle_raw", "차기 등록 예정일": "next_registration_date",
    "매체유형": "media_type", "전체행": "row_count_raw", "확장자(데이터포맷)": "format_raw", "키워드": "keywords_raw",
    "다운로드_활용신청건수": "download_count_raw", "등록일": "created_date", "수정일": "modified_date", "데이터 한계": "data_limits",
    "제공형태": "provision_type", "설명": "description", "기타 유의사항": "notes", "공간범위": "spatial_raw", "시간범위": "temporal_raw",
    "비용부과유무": "fee_raw", "비용부과기준 및 단위": "fee_basis", "이용허락범위": "license_raw", "API 유형": "api_type_raw",
    "신청가능 트래픽": "traffic", "심의 유형": "review_type", "조회수": "view_count_raw", "목록 URL": "list_url",
    "국가중점여부": "national_core_raw", "표준데이터여부": "standard_raw",
}
#: header -> internal name of the column-profile export
PROFILE_COLUMNS = {
    "dataID": "list_key", "파일데이터명": "file_name", "상위파일데이터명": "container", "데이터형태": "shape", "확장자(데이터포맷)": "ext",
    "zip_file_count": "zip_count", "전체행": "rows", "전체열": "cols", "컬럼명": "name", "컬럼명_샘플": "samples", "시트명": "sheet",
    "컬럼명_비고": "note", "고유값수": "distinct", "고유값_근사": "distinct_approx", "열순번": "ordinal",
}

#: code, name, plain aliases, ambiguous aliases
# The regions.
REGIONS = [
    ("KR-11", "서울특별시", ["서울특별시", "서울시", "서울"], []),
    ("KR-26", "부산광역시", ["부산광역시", "부산시", "부산"], []),
    ("KR-27", "대구광역시", ["대구광역시", "대구시", "대구"], []),
    ("KR-28", "인천광역시", ["인천광역시", "인천시", "인천"], []),
    ("KR-29", "광주광역시", ["광주광역시"], ["광주시", "광주"]),
    ("KR-30", "대전광역시", ["대전광역시", "대전시", "대전"], []),
    ("KR-31", "울산광역시", ["울산광역시", "울산시", "울산"], []),
    ("KR-50", "세종특별자치시", ["세종특별자치시", "세종시", "세종"], []),
    ("KR-41", "경기도", ["경기도", "경기"], []),
    ("KR-42", "강원특별자치도", ["강원특별자치도", "강원도", "강원"], []),
    ("KR-43", "충청북도", ["충청북도", "충북"], []),
    ("KR-44", "충청남도", ["충청남도", "충남"], []),
    ("KR-45", "전북특별자치도", ["전북특별자치도", "전라북도", "전북"], []),
    ("KR-46", "전라남도", ["전라남도", "전남"], []),
    ("KR-47", "경상북도", ["경상북도", "경북"], []),
    ("KR-48", "경상남도", ["경상남도", "경남"], []),
    ("KR-49", "제주특별자치도", ["제주특별자치도", "제주도", "제주"], []),
]
EVIDENCE = {"EXPLICIT_SPATIAL": 0.95, "INFERRED_FROM_TITLE": 0.8, "INFERRED_FROM_PUBLISHER": 0.6, "INFERRED_FROM_DESCRIPTION": 0.5}
AMBIGUOUS_PENALTY = 0.3

# The fields that each list type's profile asks for.
COMPLETENESS = {
    "FILE": ["title", "theme", "org_name", "update_cycle", "keywords", "description", "license", "created_date", "modified_date", "list_url", "spatial", "temporal", "data_limits", "format", "row_count", "file_data_name"],
    "API": ["title", "theme", "org_name", "update_cycle", "keywords", "description", "license", "created_date", "modified_date", "list_url", "spatial", "temporal", "data_limits", "api_type", "traffic"],
    "STD": ["title", "theme", "org_name", "update_cycle", "keywords", "description", "created_date", "modified_date", "list_url", "spatial", "temporal", "format"],
}
# Numbers that stand for none.
DUMMIES = (999999, 99999999, 9999, -1, -9)

# Words of the query interpretation.
FORMAT_ALIASES = {"CSV": "CSV", "JSON": "JSON", "XML": "XML", "XLSX": "XLSX", "엑셀": "XLSX", "EXCEL": "XLSX", "PDF": "PDF", "SHP": "SHP"}
CYCLE_ALIASES = {"일간": "DAILY", "매일": "DAILY", "주간": "WEEKLY", "매주": "WEEKLY", "월간": "MONTHLY", "매월": "MONTHLY", "분기": "QUARTERLY", "반기": "SEMIANNUAL", "연간": "ANNUAL", "매년": "ANNUAL", "수시": "IRREGULAR"}
TYPE_ALIASES = {"API": "API", "파일": "FILE", "FILE": "FILE", "표준": "STD", "STD": "STD"}
REGION_TOKENS = {a: code for code, name, plain, more in REGIONS for a in (*plain, *more, name)}

# Words and patterns of the plan rules.
STOPWORDS = ["데이터", "공공데이터", "자료", "정보", "관련", "및", "대한", "위한", "위해", "분석하고", "분석하려고", "검토", "검토하고", "활용", "활용하려고", "참고", "참고할", "싶다", "싶어", "싶습니다", "한다", "하려고", "합니다", "찾아줘", "찾아", "알려줘", "필요한", "필요하다", "중인데", "있는", "하는"]
PARTICLES = ["에서", "으로", "까지", "부터", "이나", "라도", "을", "를", "이", "가", "은", "는", "도", "의", "와", "과", "로", "에"]
ROLE_PATTERNS = {"DEMAND": r"인구|수요|이용객|이용량|이용현황|등록\s?대수|가구|세대|방문객|승하차", "SUPPLY": "시설|위치|충전소|정류장|기관|센터|병원|의원|약국|학교|주차장|쉼터|도서관", "REFERENCE": "코드|분류체계|표준"}
COLUMN_ROLE_PATTERNS = {"SPATIAL": "위도|경도|좌표|주소|소재지|행정동|법정동|시군구", "TEMPORAL": "연도|년도|일자|날짜|기준일|년월|시점"}
ANALYSIS_HINT = "접근성|수요|사각지대|입지|배치|격차|불균형|공급"
#: label -> patterns that must all be seen
JOIN_KEYS = {
    "행정구역·법정동 코드": ["행정.{0,3}코드|법정동.{0,2}코드|시군구.{0,2}코드|지역.?코드"],
    "주소·소재지": ["주소|소재지"],
    "좌표(위도·경도)": ["위도", "경도"],
    "기준 연도·일자": ["연도|년도|기준일"],
    "사업자등록번호": ["사업자.{0,2}등록.{0,2}번호"],
}

# Words and patterns of the safety screen.
NAME_WITHHELD = ["주민등록", "주민번호", "생년월일", "전화", "연락처", "휴대폰", "핸드폰", "휴대전화", "이메일", "메일주소", "email", "e-mail", "계좌", "카드번호", "차량번호", "차량 번호", "여권", "면허번호", "자격번호", "상세주소"]
NAME_WITHHELD_SUFFIX = ["성명", "대표자명", "담당자명", "신청인명", "환자명", "학생명"]
NAME_WITHHELD_EXACT = ["이름", "성함"]
NAME_REVIEW = ["민원", "상담내용", "요청사항", "질의내용", "사연"]
VALUE_PATTERNS = {
    "rrn": r"(?<!\d)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])[-\s]?[1-4]\d{6}(?!\d)",
    "mobile": r"(?<!\d)01[016789][-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "landline": r"(?<!\d)0\d{1,2}[-.\s]\d{3,4}[-.\s]\d{4}(?!\d)",
}
FREE_TEXT_LENGTH = 80
BOOL_WORDS = ["y", "n", "true", "false", "예", "아니오", "유", "무"]
TRACKED = ["title", "org_name", "theme_raw", "update_cycle", "format_raw", "license_raw", "modified_date", "description", "list_url", "row_count"]

# Patterns of family titles.
TITLE_BRACKETS = r"[\(\[［（].*?[\)\]］）]"
TITLE_DIGITS = "[0-9０-９]+"
TITLE_SEPARATORS = r"[\s_\-·.,~년월일차회호기'\"]+"
TITLE_TOKENS = r"[_\s·\-]+"
YEAR = r"(19|20)\d{2}"
