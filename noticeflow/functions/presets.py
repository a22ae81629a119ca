"""Fixed values of the procurement domain: word lists, codes and patterns that results depend on."""

TITLE_RELEVANCE = {
    "irrelevant": ["건설사업관리", "폐기물처리", "지하안전평가"],
    "compounds": [(["건설폐기물", "처리"], []), (["석면", "감리"], ["해체", "제거"]), (["교통안전시설", "기술검토"], [])],
    "audit": "감리",
    "other_audits": ["건설공사", "건설", "건축", "전기", "소방", "정보통신공사", "토목", "시설공사", "시설물"],
    "privacy_phrases": ["개인정보영향평가"],
    "privacy_word": "개인정보",
    "privacy_abbreviation": "pia",
    "actions": ["구축", "운영", "개발", "유지관리"],
    "technology": ["정보시스템", "정보화", "전산", "소프트웨어", "ict", "플랫폼", "클라우드", "데이터", "디지털"],
    "technology_abbreviation": "it",
}
AWARD_METHOD = {
    "review": "적격심사", "not_review": "부적격심사", "small": "소액수의", "small_code": "낙030029", "review_code": "낙030001",
    "negotiated": "협상", "negotiated_code": "낙030005",
    "headings": ["낙찰자선정방법", "낙찰방법", "적격심사제", "적격심사대상", "적격심사세부기준", "적격심사기준"],
    "reasons": {
        "name": '낙찰방법 필드에서 "{}" 확인', "small": "구조화 상세정보에서 소액수의견적 확인", "code": "낙찰방법 코드에서 적격심사 코드 {} 확인",
        "negotiated": "구조화 상세정보에서 협상에 의한 계약 확인", "standard": '낙찰방법 적용기준에서 "{}" 확인',
        "other": "구조화 상세정보에서 적격심사 또는 소액수의견적 근거가 확인되지 않음", "attachment": "첨부문서에서 명확한 적격심사 문맥 확인: {}",
        "none": "낙찰방법을 판정할 구조화 상세정보 또는 명확한 첨부문서 근거가 없음"},
}
ASSESSMENT_CORE = ["개인정보 영향평가", "영향평가", "PIA", "전문인력", "전문교육", "계속교육", "보수교육"]
ASSESSMENT_SUPPORT = ["자격", "자격증", "갱신", "유효기간", "신청", "접수", "마감"]
REVIEW_LABELS = ("검토대상", "추가확인필요", "제외")
ATTACHMENT_ORDER = {
    "tasks_first": [("TASK", ["과업지시"]), ("RFP", ["제안요청"]), ("NOTICE", ["공고"])],
    "notice_first": [("NOTICE", ["공고"]), ("RFP", ["제안요청"]), ("TASK", ["과업"])],
}
EVIDENCE_KINDS = [("CERTIFICATE", ["실적증명서", "실적증명원"]), ("CONTRACT", ["계약서"])]
RANKING_STOP_WORDS = ["사업", "용역", "프로젝트", "수립"]
ALLOWED_CODES_SEED = ["6146", "1468"]

# Word lists and patterns that decide which lines of a tender document are kept.
DOCUMENT_ANALYSIS = {
    "top_level": r"^\s*(?:(?:\d+\s*[.)])|(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+(?:\.|\s)))\s*.+$",
    "heading_prefix": r"^(?:(?:\d+\s*[.)])|(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+[.)]?)|[■□▢※*·◦-])\s*",
    "heading_tail": r"^[:：]?\([^)]{0,40}\)$",
    "boundary_words": [
        "입찰보증금", "입찰서 제출", "전자입찰", "개찰", "낙찰자 결정", "계약체결", "청렴계약", "제출서류", "제안서 평가", "공동수급", "하도급", "기타사항", "문의사항", "유의사항", "동반성장 지원사업"],
    "boundary_shape": r"^[■□▢※]|사항$|안내$",
    "item_start": r"^(?:[ㅇ○●▪■□▢※*·◦-]|[가-하]\s*[.)]|\(?\d+\)|[①-⑳])",
    "page_number": r"^-\s*\d+\s*-$",
    "bullets": r"^[ㅇ○●▪■□▢※*·◦-]+",
    "date_or_time": r"20\d{2}\s*[./-]\s*(?:0?[1-9]|1[0-2])(?:\s*[./-]\s*(?:0?[1-9]|[12]\d|3[01]))?|(?:[01]?\d|2[0-3]):[0-5]\d",
    "phone": r"(?<!\d)(?:0\d{1,2}[- )]?)?\d{3,4}-\d{4}(?!\d)",
    "documents": {
        "headings": ["입찰참가 제출서류", "제안서 제출서류", "참가 신청시 제출서류", "참가신청시 제출서류", "제출서류", "제출 서류", "구비서류", "구비 서류"],
        "table_heading": "구분제출서류",
        "table_headers": ["구분", "제출서류", "구분제출서류", "구분내용수량"],
        "not_items": ["구분내용수량", "제안업체", "일반사항", "자체서식", "평가", "자료"],
        "separators": r"\s*[･·•◦▪]\s*",
        "item": (
            r"사업자등록증|법인등기부등본|법인등기사항증명서|등기사항증명서|법인인감증명서|인감증명서|사용인감계|경쟁입찰참가자격\s*등록증|중소기업(?:·소상공인)?\s*확인서|소기업·소상공인\s*확인서|"
            r"직접생산확인증명서|직접생산\s*확인증명서|실적증명서|수행실적\s*총괄표|사업(?:\(용역\))?수행실적표|사업(?:\(용역\))?이행\s*실적증명(?:원)?(?:\(서\))?|"
            r"실적증명(?:원)?(?:\(서\))?|관계증빙서류|신용평가등급\s*확인서|소프트웨어\s*사업자[^,;]{0,30}?(?:관리)?확인서|"
            r"제안서(?!의)|제안요약서|요약서|견적서|입찰참가신청서|입찰서|참가신청서|신청서|확약서|서약서|자가점검표|산출내역서|재직증명서|USB|유에스비"),
        "trims": [
            r"^(?:구분|기타)\s*[-:]?\s*", r"^(?:\(?\d{1,2}\)|\d{1,2}[.)-]|[가-하][.)]|[①-⑳])\s*", r"\s*\d{1,2}-\s*(?:최근년도\s+결산\s+신고된)?\s*$", r"\s*\d{1,2}\s*평가항목\s*$",
            r"\s*\d{1,2}-\s*기타\s+제안서의.+(?:있는|있는\s*)$", r"[”\"']?\s*\d{1,2}-\s*$", r"\s+(?:및|,|/)$"],
        "words": [
            "사업자등록증", "법인등기부등본", "등기사항증명서", "인감증명서", "사용인감계", "경쟁입찰참가자격등록증", "경쟁입찰참가자격 등록증", "중소기업 확인서", "중소기업확인서", "직접생산확인증명서",
            "직접생산 확인증명서", "실적증명", "제안서", "견적서", "확약서", "서약서", "확인서", "증명서", "신청서", "입찰서", "산출내역서", "USB", "유에스비", "재직증명서", "평가항목 자가점검표",
            "관계증빙서류", "사본", "원본", "1부", "2부", "3부"],
        "unless": [
            "업종코드", "세부품명", "검사요청", "검사를 요청", "용역수행 결과물", "용역 결과물", "품질보증", "보안 및 안전", "안전교육", "과업 수행", "사후판정", "입찰보증금", "적정성 적합", "계약상대자는",
            "원본과 사본의 차이", "인감날인)계량"],
    },
    "qualifications": {
        "headings": ["입찰 참가자격", "입찰참가자격", "참가자격"],
        "words": [
            "업종코드", "감리법인", "입찰참가 등록", "입찰 참가 등록", "입찰참가자격", "참가자격", "부정당업자", "참가할 수 없", "참여할 수 없", "등록취소", "업무정지", "소프트웨어사업자", "중소기업", "직접생산",
            "수행실적", "실적을", "지역제한", "소재한", "부도", "파산"],
        "unless": [
            "입찰보증금", "납세증명", "납부증명", "인지세", "대금 청구", "대가 청구", "계약체결 시", "계약체결시", "계약상대자", "청렴계약", "문의하시기", "문의바랍니다", "신고처", "신고하거나", "감사실", "이의제기",
            "민원", "동반성장", "지원사업 안내", "판로지원", "홈페이지 제작", "제출서류 (", "제출서류(", "인감증명서", "사용인감계", "사본 1부", "원본 1부"],
    },
    "methods": {
        "headings": [
            "제출방법", "제출 방법", "제출처", "제출 및 문의처", "우편", "직접 제출", "방문 제출", "전자 제출", "전자제출", "온라인 제출", "이메일", "E-mail", "e-mail"],
        "acts": ["제출", "접수", "입찰서", "참가 신청", "참가신청"],
        "words": ["나라장터", "전자제출", "전자 제출", "온라인", "이메일", "e-mail", "E-mail", "방문", "우편", "직접", "제출방법", "제출 방법"],
        "unless": [
            "신고", "감사실", "이의제기", "민원", "불공정행위", "비리", "금품", "향응", "갑질", "문의", "불편사항", "계약업무", "레드휘슬", "청렴계약", "계약서를 제출", "조세포탈", "유죄판결 비대상자",
            "입찰보증금", "보증금", "지급각서", "하도급", "직불", "산출물", "결과물", "검사요청", "납품", "착수", "완료보고", "준공", "과업 수행", "과업수행", "입찰참가자격등록", "입찰참가자격 등록",
            "참가자격등록", "참가자격 등록"],
        "own": ["입찰서", "제안서", "입찰참가", "참가신청", "참가 신청", "사전접수", "사전 접수"],
        "before": ["입찰서 제출", "제안서 제출", "입찰참가 신청", "입찰참가신청", "제출서류", "제출 및 문의처", "서류 제출", "참가신청"],
        "after_award": ["산출물", "성과품", "결과물", "납품", "검사", "준공", "완료보고", "과업 수행", "과업수행"],
    },
    "deadlines": {
        "headings": [
            "제출기한", "제출 기한", "접수기한", "접수 기한", "제출마감", "제출 마감", "접수마감", "접수 마감", "마감일", "제출기간", "제출 기간", "접수기간", "접수 기간", "제출일시", "접수일시",
            "입찰서 제출", "입찰서 접수", "제안서 제출", "참가신청 접수", "참가 신청 접수"],
        "acts": ["입찰서", "제안서", "서류", "제출", "접수", "참가신청", "참가 신청", "투찰"],
        "labels": ["시작", "마감", "개시", "종료", "일시"],
        "stops": ["개찰", "개찰일시", "개찰시간"],
        "unless": [
            "납부기한", "입찰보증금", "참가자격", "참가 등록", "참가등록", "등록한 업체", "업무정지", "신용평가등급", "계약체결", "대금 청구", "개찰", "문의", "전화", "연락처", "대표번호", "고객센터"],
    },
    "joint": {
        "headings": ["공동수급협정서", "공동수급", "공동도급"],
        "clauses": r"(?=[◦▢□]|\uFFFD+)",
        "words": [
            "허용", "불허", "공동이행", "분담이행", "대표사", "주관사업자", "구성원", "개 이하", "지분율", "최소지분", "중복", "협정서", "변경할 수 없", "변경 불가", "단독이행", "단독 이행", "제출"],
        "unless": [
            "평가점수", "배점", "평가요소", "평가한다", "등급별", "수행조직관리", "평가하고", "평가 결과", "점수를", "관리 및 수행방안", "실적은", "참여비율 제시", "참여지분율평가", "이행부분이 구분",
            "형식적인 공동수급체", "입찰보증금", "보증금", "귀속", "보증서", "연대책임", "변경등록", "상호 및 대표자", "대표자 전원", "당사(공동수급체 구성원", "당사 (공동수급체 구성원"],
    },
    "award": {"words": ["적격심사"], "unless": ["부적격심사"], "with": ["낙찰자선정방법", "낙찰방법", "적격심사제", "적격심사대상", "적격심사세부기준", "적격심사기준"]},
}
# Headers of pasted tables.
PASTED_HEADERS = {"title": ["사업명"], "client": ["발주기관", "발주처"], "period": ["사업기간"], "amount": ["사업금액", "계약금액"]}
