"""What the queries of ``cases.py`` must give: for each query rows of (number of the input, columns in their order).

Recorded, and reviewed row by row against the rules of each operator; the tests of the operators assert the same behaviour apart.
"""

# Expected rows.
ROWS: dict[str, list[tuple]] = {
    'matcher_hits': [
        (0, '바카라', '도박', 'keyword', 'exact', '바카라', '바카라', 3, "도박 키워드 '바카라'"),
        (0, '카지노', '도박', 'keyword', 'exact', '카지노', '카지노', 3, "도박 키워드 '카지노'"),
        (1, '토토사이트', '도박', 'keyword', 'exact', '토.토.사.이.트', '토토사이트', 3, "도박 키워드 '토토사이트'"),
        (3, '카지노', '도박', 'variant', 'normalize', '카\u200b지노', '카지노', 3, "도박 키워드 '카지노' · 변형 표기: 카\u200b지노 → 카지노 (보이지 않는 문자·전각 등 호환 문자)"),
        (4, 'casino', '도박', 'variant', 'confusable', 'саsino', 'casino', 3, "도박 키워드 'casino' · 변형 표기: саsino → casino (닮은꼴 문자, UTS #39)"),
        (5, 'porn', '성인', 'variant', 'normalize', 'ｐｏｒｎ', 'porn', 3, "성인 키워드 'porn' · 변형 표기: ｐｏｒｎ → porn (보이지 않는 문자·전각 등 호환 문자)"),
        (6, 'porn', '성인', 'variant', 'enclosed', 'ⓟⓞⓡⓝ', 'porn', 3, "성인 키워드 'porn' · 변형 표기: ⓟⓞⓡⓝ → porn (감싼 문자)"),
        (7, 'porn', '성인', 'variant', 'styled', '𝐩𝐨𝐫𝐧', 'porn', 3, "성인 키워드 'porn' · 변형 표기: 𝐩𝐨𝐫𝐧 → porn (특수 글꼴·첨자 문자)"),
        (8, 'viagra', '불법의약품', 'variant', 'accent', 'vîågrà', 'viagra', 3, "불법의약품 키워드 'viagra' · 변형 표기: vîågrà → viagra (악센트 문자)"),
        (9, '바카라', '도박', 'variant', 'digits', '바7라', '바카라', 2, "도박 키워드 '바카라' · 변형 표기: 바7라 → 바카라 (숫자·영문 치환)"),
        (10, '슬롯', '도박', 'variant', 'symbols', '슬-롯', '슬롯', 1, "도박 키워드 '슬롯' · 변형 표기: 슬-롯 → 슬롯 (기호 삽입)"),
        (11, '바카라', '도박', 'variant', 'sound', '밖콰라', '바카라', 2, "도박 키워드 '바카라' · 변형 표기: 밖콰라 → 바카라 (발음 변형)"),
        (12, '카지노', '도박', 'variant', 'sound', '카찌노', '카지노', 2, "도박 키워드 '카지노' · 변형 표기: 카찌노 → 카지노 (발음 변형)"),
        (13, '카지노', '도박', 'variant', 'chosung', 'ㅋㅈㄴ', '카지노', 2, "도박 키워드 '카지노' · 변형 표기: ㅋㅈㄴ → 카지노 (초성 표기)"),
        (14, '바카라', '도박', 'variant', 'chosung', '㉥㉪㉣', '바카라', 2, "도박 키워드 '바카라' · 변형 표기: ㉥㉪㉣ → 바카라 (초성 표기)"),
        (15, '카지노', '도박', 'variant', 'keyboard', 'zkwlsh', '카지노', 2, "도박 키워드 '카지노' · 변형 표기: zkwlsh → 카지노 (한영 자판 변환)"),
        (16, '바카라', '도박', 'variant', 'keyboard', 'qkzkfk', '바카라', 2, "도박 키워드 '바카라' · 변형 표기: qkzkfk → 바카라 (한영 자판 변환)"),
        (17, '스포츠토토', '도박', 'keyword', 'exact', '스포츠토토', '스포츠토토', 2, "도박 키워드 '스포츠토토'"),
        (17, '토토', '도박', 'keyword', 'exact', '토토', '토토', 1, "도박 키워드 '토토'"),
        (24, '급전', '작업대출', 'keyword', 'exact', '급전', '급전', 2, "작업대출 키워드 '급전'"),
        (24, '대출', '작업대출', 'keyword', 'exact', '대출', '대출', 1, "작업대출 키워드 '대출'"),
        (25, '무료 영상', '성인', 'variant', 'spaces', '무 료 영 상', '무료 영상', 1, "성인 키워드 '무료 영상' · 변형 표기: 무 료 영 상 → 무료 영상 (띄어쓰기 변형)"),
        (26, '가입코드', '도박', 'keyword', 'exact', '가입코드', '가입코드', 2, "도박 키워드 '가입코드'"),
        (26, '입금 보너스', '도박', 'keyword', 'exact', '입금보너스', '입금 보너스', 2, "도박 키워드 '입금 보너스'"),
        (27, '바카라', '도박', 'variant', 'sound', '밖카라', '바카라', 2, "도박 키워드 '바카라' · 변형 표기: 밖카라 → 바카라 (발음 변형)"),
        (27, '카지노', '도박', 'keyword', 'exact', '카지노', '카지노', 3, "도박 키워드 '카지노'"),
        (29, 'casino', '도박', 'keyword', 'exact', 'casino', 'casino', 3, "도박 키워드 'casino'"),
        (30, '성인', '성인', 'keyword', 'exact', '성인', '성인', 1, "성인 키워드 '성인'"),
        (30, '성인용품', '성인', 'variant', 'spaces', '성인 용품', '성인용품', 1, "성인 키워드 '성인용품' · 변형 표기: 성인 용품 → 성인용품 (띄어쓰기 변형)"),
        (31, '토토', '도박', 'keyword', 'exact', '토토', '토토', 1, "도박 키워드 '토토'"),
        (32, '먹튀', '도박', 'keyword', 'exact', '먹튀', '먹튀', 3, "도박 키워드 '먹튀'"),
        (32, '바카라', '도박', 'keyword', 'exact', '바.카.라', '바카라', 3, "도박 키워드 '바카라'"),
        (33, '불법환전', '불법환전', 'keyword', 'exact', '불법환전', '불법환전', 3, "불법환전 키워드 '불법환전'"),
        (33, '환전', '도박', 'keyword', 'exact', '환전', '환전', 1, "도박 키워드 '환전'"),
    ],
    'matcher_spans': [
        (0, '바카라', 4, 7),
        (0, '카지노', 0, 3),
        (1, '토토사이트', 0, 9),
        (17, '스포츠토토', 0, 5),
        (17, '토토', 6, 8),
        (24, '급전', 7, 9),
        (24, '대출', 3, 5),
        (26, '가입코드', 7, 11),
        (26, '입금 보너스', 0, 5),
        (27, '카지노', 0, 3),
        (27, '카지노', 4, 7),
        (29, 'casino', 0, 6),
        (29, 'casino', 7, 13),
        (30, '성인', 3, 5),
        (31, '토토', 0, 2),
        (32, '먹튀', 6, 8),
        (32, '바카라', 0, 5),
        (33, '불법환전', 0, 4),
        (33, '환전', 5, 7),
    ],
    'matcher_words': [
        (0, '카지노,바카라'),
        (1, '토토사이트'),
        (17, '스포츠토토,토토'),
        (24, '급전,대출'),
        (26, '입금 보너스,가입코드'),
        (27, '카지노'),
        (29, 'casino'),
        (30, '성인'),
        (31, '토토'),
        (32, '바카라,먹튀'),
        (33, '불법환전,환전'),
    ],
    'text_readings': [
        (0, 'x가ye', 'enclosed,accent', 'x가ye'),
        (1, 'A120 AK', 'enclosed', 'A120 AK'),
        (2, 'ab a2x', 'styled', 'ab a2x'),
        (3, 'Straße Ore lodz', 'accent', 'Straße Ore lodz'),
        (4, 'ПOPHO popn', 'confusable', 'ПOPHO popn'),
        (5, 'Ꭺ ㄱ ㄱ', 'enclosed', 'G ㄱ ㄱ'),
        (6, 'abc', '', 'abc'),
        (7, '秘1a', 'enclosed', '秘1a'),
        (8, 'plain ASCII', '', 'plain ASCII'),
        (9, '가나다 ㄱㄴ', '', '가나다 ㄱㄴ'),
    ],
    'contact_cases': [
        (0, 'telegram', '텔레그램 @win7777', False),
        (1, 'telegram', '텔레 아이디: abcd12', False),
        (2, 'telegram', 't.me/joinchat+1', False),
        (3, 'contact', '카톡 vip777', False),
        (4, 'contact', '라인 아이디 : line_77', False),
        (5, 'contact', '@agent_01', False),
        (6, '', '', False),
        (7, 'contact', '010-1234-5678', False),
        (8, '', '', False),
        (9, '', '', True),
        (10, '', '', True),
        (11, 'telegram', 'tg: king777', False),
        (12, '', '', False),
        (13, '', '', False),
        (14, 'telegram', '텔레그램 @cop_1234', True),
    ],
    'url_cases': [
        (0, 'https://www.p{p}.kr/a?x=1', True, '../a?x=1#y'),
        (1, 'https://f.kr/', False, '//f.kr'),
        (2, '', False, 'javascript:go()'),
        (3, '', False, '#top'),
        (4, '', False, ''),
        (5, 'http://a.kr/B?q=1', False, 'HTTP://A.kr:80/B?q=1'),
        (6, 'https://a.kr/', False, 'https://a.kr:443'),
        (7, 'http://a.kr:8080/x', False, 'http://a.kr:8080/x'),
        (8, 'https://a.kr/list?page=2', True, '?page=2'),
        (9, '', False, 'mailto:x@a.kr'),
        (10, 'https://a.kr/logout', False, '/logout'),
        (11, '', False, 'ftp://a.kr/x'),
        (12, 'https://a.kr/trim', True, ' /trim '),
        (13, 'https://a.kr/file.PDF', False, '/file.PDF'),
        (14, 'https://a.kr/board?mode=delete&id=1', False, '/board?mode=delete&id=1'),
        (15, 'https://a.kr/%EA%B8%80+1?q=%EA%B8%80+2', True, '/글+1?q=글 2'),
    ],
    'redirect_cases': [
        (0, 'https://x{p}.kr/a', 'http://y.kr/b'),
        (1, 'http://a.kr/1 http://b.kr/2', 'http://c.kr/'),
        (2, '', ''),
        (3, '', ''),
    ],
    'standing_links': [
        (0, True, '캡차|봇 차단|Checking your browser'),
        (1, True, ''),
        (2, True, '캡차|봇 차단|Checking your browser'),
        (3, True, ''),
        (4, False, '캡차|봇 차단|Checking your browser'),
        (5, True, ''),
        (6, True, '캡차|봇 차단|Checking your browser'),
        (7, False, ''),
    ],
    'echoed_params': [
        (0, 'q=카지노!', 'q=카지노!', "' ' 검색 결과", True),
        (1, 'q=바카라!', 'q=바카라!', '  결과', True),
        (2, 'u=http://my-casino.kr!&q=공지', 'u=http://my-casino.kr!', '공지   로', False),
        (3, 'q=x&w=먹튀!&v=토토사이트!', 'w=먹튀!&v=토토사이트!', '     ', False),
        (4, '', '', '카지노', True),
        (5, 'b=슬롯사이트 보기!', 'b=슬롯사이트 보기!', ' ', False),
        (6, 's=카', '', '카', True),
    ],
    'host_cases': [
        (0, '도박', False, 'my-casino.kr'),
        (1, '도박', False, 'toto777.com'),
        (2, '성인', False, 'sexy.co.kr'),
        (3, '', False, 'alphabet.com'),
        (4, '', False, 'totorial.kr'),
        (5, '', True, 'www.city.go.kr'),
        (6, '', True, 'youtube.com.'),
        (7, '', False, 'notyoutube.com'),
        (8, '도박', False, 'bet365.net'),
        (9, '', False, 'example.org'),
        (10, '', False, 'trusted.kr'),
        (11, '', False, ''),
        (12, '성인', False, 'jav-av.tv'),
        (13, '', False, ''),
    ],
    'detected_findings': [
        (0, 1, 'high', '불법광고 의심', 11, 'hidden', '숨김 광고', '도박', 'hidden', '바카라 텔레그램 @win7777', 'div.x', 2, 'http://win-toto.invalid/', "keyword|도박 키워드 '바카라'|3; domain|의심 도메인: win-toto.invalid|3; hidden|숨김 처리 (display:none)|2; external|화이트리스트에 없는 외부 도메인|1; contact|텔레그램 ID 포함 (텔레그램 @win7777)|2", '', '', '2개 페이지에서 발견', '보이지 않게 넣은 광고입니다. 요소를 지우고 편집기 필터와 계정을 점검하세요.'),
        (1, 1, 'high', '불법광고 의심', 7, 'visible', '노출 광고', '도박', 'text', '먹튀 없는 놀이터', '#p', 1, 'http://bet365.invalid/', "keyword|도박 키워드 '먹튀'|3; domain|의심 도메인: bet365.invalid|3; external|화이트리스트에 없는 외부 도메인|1", '', '', 'https://www.city.go.kr/a', '화면에 보이는 광고입니다. 글을 지우고 작성 경로의 스팸 차단을 점검하세요.'),
        (2, 1, 'suspect', '검토 필요', 4, 'visible', '노출 광고', '도박', 'link', '바로가기', '#l', 1, 'http://my-toto.invalid/', 'domain|의심 도메인: my-toto.invalid|3; external|화이트리스트에 없는 외부 도메인|1', '글 목록', '글 목록', 'https://www.city.go.kr/a', '화면에 보이는 광고입니다. 글을 지우고 작성 경로의 스팸 차단을 점검하세요.'),
        (5, 1, 'high', '불법광고 의심', 8, 'visible', '노출 광고', '도박', 'text', '먹튀 예방 카지노 텔레그램 @win7777', '#t', 1, '', "keyword|도박 키워드 '카지노'|3; keyword|도박 키워드 '먹튀'|3; contact|텔레그램 ID 포함 (텔레그램 @win7777)|2", '', '', 'https://www.city.go.kr/a', '화면에 보이는 광고입니다. 글을 지우고 작성 경로의 스팸 차단을 점검하세요.'),
        (6, 1, 'suspect', '검토 필요', 5, 'reflection_surface', '악용 가능 지점', '도박', 'text', "'카지노' 검색 결과", '#t', 1, '', "keyword|도박 키워드 '카지노'|3; reflection|URL 파라미터 반사 (q=카지노)|2", '', '', 'https://www.city.go.kr/s?q=카지노', '입력값이 그대로 출력됩니다. 지금은 광고가 아니지만 악용될 수 있으므로 출력을 막으세요.'),
        (7, 1, 'high', '불법광고 의심', 8, 'param_reflection', 'URL 파라미터 반사', '도박', 'text', '카지노 바카라 추천', '#t', 1, '', "keyword|도박 키워드 '카지노'|3; keyword|도박 키워드 '바카라'|3; reflection|URL 파라미터 반사 (q=카지노 바카라)|2", '', '', 'https://www.city.go.kr/s?q=카지노 바카라', '주소 파라미터가 화면에 그대로 나타납니다. 출력 전에 값을 걸러 내고 검색엔진에 해당 주소 삭제를 요청하세요.'),
        (8, 1, 'high', '불법광고 의심', 5, 'param_reflection', 'URL 파라미터 반사', '도박', 'text', '카지노 글', '#t', 1, '', "keyword|도박 키워드 '카지노'|3; reflection|URL 파라미터 반사 (id=카지노)|2", '', '', 'https://www.city.go.kr/s?id=카지노', '주소 파라미터가 화면에 그대로 나타납니다. 출력 전에 값을 걸러 내고 검색엔진에 해당 주소 삭제를 요청하세요.'),
        (9, 1, 'high', '불법광고 의심', 5, 'hidden', '숨김 광고', '도박', 'text', '먹튀 검증 안내', '#t', 1, '', "keyword|도박 키워드 '먹튀'|3; hidden|숨겨진 iframe 내부|2", '', '', 'https://www.city.go.kr/a', '보이지 않게 넣은 광고입니다. 요소를 지우고 편집기 필터와 계정을 점검하세요.'),
        (10, 1, 'high', '불법광고 의심', 15, 'hidden', '숨김 광고', '도박', 'hidden', '바카라 카지노 먹튀', '#a > b', 1, 'http://bet.invalid/', "keyword|도박 키워드 '카지노'|3; keyword|도박 키워드 '바카라'|3; keyword|도박 키워드 '먹튀'|3; domain|의심 도메인: bet.invalid|3; hidden|숨김 처리 (숨김 영역 안)|2; external|화이트리스트에 없는 외부 도메인|1", '', '', 'https://www.city.go.kr/a', '보이지 않게 넣은 광고입니다. 요소를 지우고 편집기 필터와 계정을 점검하세요.'),
        (11, 1, 'suspect', '검토 필요', 4, 'redirect', '자동 이동', '도박', 'page_redirect', 'http://evil-casino.invalid/', '', 1, '', 'redirect|다른 사이트로 자동 이동: evil-casino.invalid|3; external|화이트리스트에 없는 외부 도메인|1', None, None, 'https://www.city.go.kr/r', '방문자를 다른 사이트로 보내는 코드가 있습니다. 소스와 서버 파일이 바뀌었는지 확인하세요.'),
        (12, 1, 'high', '불법광고 의심', 7, 'redirect', '자동 이동', '도박', 'redirect', "0; url='http://slot-king.invalid/'", 'meta', 1, 'http://slot-king.invalid/', 'domain|의심 도메인: slot-king.invalid|3; redirect|meta refresh 자동 이동|3; external|화이트리스트에 없는 외부 도메인|1', '', '', 'https://www.city.go.kr/a', '방문자를 다른 사이트로 보내는 코드가 있습니다. 소스와 서버 파일이 바뀌었는지 확인하세요.'),
        (13, 1, 'high', '불법광고 의심', 5, 'search_list', '검색어 목록 오염', '도박', 'link', '먹튀', '#k', 1, 'https://www.city.go.kr/q', "keyword|도박 키워드 '먹튀'|3; search_list|사이트 검색어 목록(인기 검색어)에 올라 있음|2", '', '검색어', 'https://www.city.go.kr/a', '검색어 목록에 광고가 올라 있습니다. 검색어를 지우고 금칙어와 자동 노출을 점검하세요.'),
        (14, 1, 'high', '불법광고 의심', 8, 'hidden', '숨김 광고', '도박', 'meta', '카지노 바카라', 'meta[name="keywords"]', 1, '', "keyword|도박 키워드 '카지노'|3; keyword|도박 키워드 '바카라'|3; hidden|검색엔진용 정보(keywords)에만 들어 있음|2", '', '', 'https://www.city.go.kr/a', '보이지 않게 넣은 광고입니다. 요소를 지우고 편집기 필터와 계정을 점검하세요.'),
        (14, 2, 'high', '불법광고 의심', 8, 'hidden', '숨김 광고', '도박', 'alt', '카지노 바카라', '#i', 1, '', "keyword|도박 키워드 '카지노'|3; keyword|도박 키워드 '바카라'|3; hidden|이미지 대체 텍스트(alt)에 들어 있음|2", '', '', 'https://www.city.go.kr/a', '보이지 않게 넣은 광고입니다. 요소를 지우고 편집기 필터와 계정을 점검하세요.'),
        (14, 3, 'high', '불법광고 의심', 8, 'hidden', '숨김 광고', '도박', 'noscript', '카지노 바카라', '#n', 1, '', "keyword|도박 키워드 '카지노'|3; keyword|도박 키워드 '바카라'|3; hidden|noscript 안(스크립트가 꺼진 환경·검색엔진에만 보임)|2", '', '', 'https://www.city.go.kr/a', '보이지 않게 넣은 광고입니다. 요소를 지우고 편집기 필터와 계정을 점검하세요.'),
        (15, 1, 'high', '불법광고 의심', 7, 'stuffing', '키워드 도배', '도박', 'page_stuffing', '키워드 도배(해킹 생성 페이지 의심): 토토사이트, 카지노, 바카라, 먹튀 등 4종 32회', '', 1, '', 'stuffing|광고 키워드 4종이 32회 반복됨|3; stuffing|본문 글자의 100%가 광고 키워드|2; stuffing|의미 없이 키워드만 나열한 줄 8개|2', None, None, 'https://www.city.go.kr/a', '광고 키워드만 되풀이하는 페이지입니다. 생성 이력과 관리자 계정을 확인하고 페이지를 삭제하세요.'),
        (17, 1, 'high', '불법광고 의심', 6, 'hidden', '숨김 광고', '도박', 'link', '바.카.라 추천', '#s1', 1, 'http://ads.invalid/', "keyword|도박 키워드 '바카라'|3; hidden|숨김 처리 (숨김 영역 안)|2; external|화이트리스트에 없는 외부 도메인|1", '', '', 'https://www.city.go.kr/a', '보이지 않게 넣은 광고입니다. 요소를 지우고 편집기 필터와 계정을 점검하세요.'),
        (18, 1, 'high', '불법광고 의심', 17, 'cloaking', '클로킹(구글봇)', '도박', 'cloaking', '카지노', '[구글봇]', 1, 'http://casino.invalid/', "cloaking|구글봇에게만: 광고 키워드 카지노, 바카라, 먹튀|3; keyword|도박 키워드 '카지노'|3; keyword|도박 키워드 '바카라'|3; keyword|도박 키워드 '먹튀'|3; domain|의심 도메인: casino.invalid|3; external|구글봇으로 볼 때만 외부 링크: casino.invalid|1; cloaking|일반 PC 화면과 내용이 크게 다름 (같은 단어 40%)|1", None, None, 'https://www.city.go.kr/a', '접속 방식에 따라 내용이 달라집니다. 서버 설정과 스크립트의 변조 여부를 확인하세요.'),
        (18, 2, 'high', '불법광고 의심', 6, 'cloaking', '클로킹(구글 경유)', '도박', 'cloaking', '다른 사이트로 이동: http://jump-bet.invalid/', '[구글 검색 경유]', 1, 'http://jump-bet.invalid/', 'cloaking|구글 검색 경유 접속일 때만 다른 사이트로 이동: jump-bet.invalid|3; domain|의심 도메인: jump-bet.invalid|3', None, None, 'https://www.city.go.kr/a', '접속 방식에 따라 내용이 달라집니다. 서버 설정과 스크립트의 변조 여부를 확인하세요.'),
        (20, 1, 'high', '불법광고 의심', 6, 'visible', '노출 광고', '성인', 'text', 'ⓟⓞⓡⓝ 밖콰라', '#v', 1, 'http://a.invalid/ http://b.invalid/', "variant|성인 키워드 'porn' · 변형 표기: ⓟⓞⓡⓝ → porn (감싼 문자)|3; variant|도박 키워드 '바카라' · 변형 표기: 밖콰라 → 바카라 (발음 변형)|2; external|화이트리스트에 없는 외부 도메인|1", '', '', 'https://www.city.go.kr/a', '화면에 보이는 광고입니다. 글을 지우고 작성 경로의 스팸 차단을 점검하세요.'),
    ],
    'finding_pages': [
        (0, 1, 0, 'https://www.city.go.kr/a'),
        (0, 1, 1, 'https://www.city.go.kr/b'),
        (1, 1, 0, 'https://www.city.go.kr/a'),
        (2, 1, 0, 'https://www.city.go.kr/a'),
        (5, 1, 0, 'https://www.city.go.kr/a'),
        (6, 1, 0, 'https://www.city.go.kr/s?q=카지노'),
        (7, 1, 0, 'https://www.city.go.kr/s?q=카지노 바카라'),
        (8, 1, 0, 'https://www.city.go.kr/s?id=카지노'),
        (9, 1, 0, 'https://www.city.go.kr/a'),
        (10, 1, 0, 'https://www.city.go.kr/a'),
        (11, 1, 0, 'https://www.city.go.kr/r'),
        (12, 1, 0, 'https://www.city.go.kr/a'),
        (13, 1, 0, 'https://www.city.go.kr/a'),
        (14, 1, 0, 'https://www.city.go.kr/a'),
        (14, 2, 0, 'https://www.city.go.kr/a'),
        (14, 3, 0, 'https://www.city.go.kr/a'),
        (15, 1, 0, 'https://www.city.go.kr/a'),
        (17, 1, 0, 'https://www.city.go.kr/a'),
        (18, 1, 0, 'https://www.city.go.kr/a'),
        (18, 2, 0, 'https://www.city.go.kr/a'),
        (20, 1, 0, 'https://www.city.go.kr/a'),
    ],
    'report_texts': [
        (0, 1, 'div.x', 'display:none', '', 'http://win-toto.invalid/', "도박 키워드 '바카라' (+3)\n의심 도메인: win-toto.invalid (+3)\n숨김 처리 (display:none) (+2)\n화이트리스트에 없는 외부 도메인 (+1)\n텔레그램 ID 포함 (텔레그램 @win7777) (+2)"),
        (1, 1, '#p', '', '', 'http://bet365.invalid/', "도박 키워드 '먹튀' (+3)\n의심 도메인: bet365.invalid (+3)\n화이트리스트에 없는 외부 도메인 (+1)"),
        (2, 1, '#l', '', '', 'http://my-toto.invalid/', '의심 도메인: my-toto.invalid (+3)\n화이트리스트에 없는 외부 도메인 (+1)'),
        (5, 1, '#t', '', '', '', "도박 키워드 '카지노' (+3)\n도박 키워드 '먹튀' (+3)\n텔레그램 ID 포함 (텔레그램 @win7777) (+2)"),
        (6, 1, '#t', '', 'q=카지노', '', "도박 키워드 '카지노' (+3)\nURL 파라미터 반사 (q=카지노) (+2)"),
        (7, 1, '#t', '', 'q=카지노 바카라', '', "도박 키워드 '카지노' (+3)\n도박 키워드 '바카라' (+3)\nURL 파라미터 반사 (q=카지노 바카라) (+2)"),
        (8, 1, '#t', '', 'id=카지노', '', "도박 키워드 '카지노' (+3)\nURL 파라미터 반사 (id=카지노) (+2)"),
        (9, 1, '#f ▶ #t', '', '', '', "도박 키워드 '먹튀' (+3)\n숨겨진 iframe 내부 (+2)"),
        (10, 1, '#a > b', '', '', 'http://bet.invalid/', "도박 키워드 '카지노' (+3)\n도박 키워드 '바카라' (+3)\n도박 키워드 '먹튀' (+3)\n의심 도메인: bet.invalid (+3)\n숨김 처리 (숨김 영역 안) (+2)\n화이트리스트에 없는 외부 도메인 (+1)"),
        (11, 1, '', '', '', '', '다른 사이트로 자동 이동: evil-casino.invalid (+3)\n화이트리스트에 없는 외부 도메인 (+1)'),
        (12, 1, 'meta', '', '', 'http://slot-king.invalid/', '의심 도메인: slot-king.invalid (+3)\nmeta refresh 자동 이동 (+3)\n화이트리스트에 없는 외부 도메인 (+1)'),
        (13, 1, '#k', '', '', 'https://www.city.go.kr/q', "도박 키워드 '먹튀' (+3)\n사이트 검색어 목록(인기 검색어)에 올라 있음 (+2)"),
        (14, 1, 'meta[name="keywords"]', '', '', '', "도박 키워드 '카지노' (+3)\n도박 키워드 '바카라' (+3)\n검색엔진용 정보(keywords)에만 들어 있음 (+2)"),
        (14, 2, '#i', '', '', '', "도박 키워드 '카지노' (+3)\n도박 키워드 '바카라' (+3)\n이미지 대체 텍스트(alt)에 들어 있음 (+2)"),
        (14, 3, '#n', '', '', '', "도박 키워드 '카지노' (+3)\n도박 키워드 '바카라' (+3)\nnoscript 안(스크립트가 꺼진 환경·검색엔진에만 보임) (+2)"),
        (15, 1, '', '', '', '', '광고 키워드 4종이 32회 반복됨 (+3)\n본문 글자의 100%가 광고 키워드 (+2)\n의미 없이 키워드만 나열한 줄 8개 (+2)'),
        (17, 1, '#s1', '', '', 'http://ads.invalid/', "도박 키워드 '바카라' (+3)\n숨김 처리 (숨김 영역 안) (+2)\n화이트리스트에 없는 외부 도메인 (+1)"),
        (18, 1, '[구글봇]', '', '', 'http://casino.invalid/', "구글봇에게만: 광고 키워드 카지노, 바카라, 먹튀 (+3)\n도박 키워드 '카지노' (+3)\n도박 키워드 '바카라' (+3)\n도박 키워드 '먹튀' (+3)\n의심 도메인: casino.invalid (+3)\n구글봇으로 볼 때만 외부 링크: casino.invalid (+1)\n일반 PC 화면과 내용이 크게 다름 (같은 단어 40%) (+1)"),
        (18, 2, '[구글 검색 경유]', '', '', 'http://jump-bet.invalid/', '구글 검색 경유 접속일 때만 다른 사이트로 이동: jump-bet.invalid (+3)\n의심 도메인: jump-bet.invalid (+3)'),
        (20, 1, '#v', '', '', 'http://a.invalid/\nhttp://b.invalid/', "성인 키워드 'porn' · 변형 표기: ⓟⓞⓡⓝ → porn (감싼 문자) (+3)\n도박 키워드 '바카라' · 변형 표기: 밖콰라 → 바카라 (발음 변형) (+2)\n화이트리스트에 없는 외부 도메인 (+1)"),
    ],
    'findings_by_kind': [
        (0, '도박', None, 1, 1, 0),
        (0, None, '숨김 광고', 1, 1, 0),
        (0, None, None, 1, 1, 0),
        (1, '도박', None, 1, 1, 0),
        (1, None, '노출 광고', 1, 1, 0),
        (1, None, None, 1, 1, 0),
        (2, '도박', None, 1, 0, 1),
        (2, None, '노출 광고', 1, 0, 1),
        (2, None, None, 1, 0, 1),
        (5, '도박', None, 1, 1, 0),
        (5, None, '노출 광고', 1, 1, 0),
        (5, None, None, 1, 1, 0),
        (6, '도박', None, 1, 0, 1),
        (6, None, '악용 가능 지점', 1, 0, 1),
        (6, None, None, 1, 0, 1),
        (7, '도박', None, 1, 1, 0),
        (7, None, 'URL 파라미터 반사', 1, 1, 0),
        (7, None, None, 1, 1, 0),
        (8, '도박', None, 1, 1, 0),
        (8, None, 'URL 파라미터 반사', 1, 1, 0),
        (8, None, None, 1, 1, 0),
        (9, '도박', None, 1, 1, 0),
        (9, None, '숨김 광고', 1, 1, 0),
        (9, None, None, 1, 1, 0),
        (10, '도박', None, 1, 1, 0),
        (10, None, '숨김 광고', 1, 1, 0),
        (10, None, None, 1, 1, 0),
        (11, '도박', None, 1, 0, 1),
        (11, None, '자동 이동', 1, 0, 1),
        (11, None, None, 1, 0, 1),
        (12, '도박', None, 1, 1, 0),
        (12, None, '자동 이동', 1, 1, 0),
        (12, None, None, 1, 1, 0),
        (13, '도박', None, 1, 1, 0),
        (13, None, '검색어 목록 오염', 1, 1, 0),
        (13, None, None, 1, 1, 0),
        (14, '도박', None, 3, 3, 0),
        (14, None, '숨김 광고', 3, 3, 0),
        (14, None, None, 3, 3, 0),
        (15, '도박', None, 1, 1, 0),
        (15, None, '키워드 도배', 1, 1, 0),
        (15, None, None, 1, 1, 0),
        (17, '도박', None, 1, 1, 0),
        (17, None, '숨김 광고', 1, 1, 0),
        (17, None, None, 1, 1, 0),
        (18, '도박', None, 2, 2, 0),
        (18, None, '클로킹(구글 경유)', 1, 1, 0),
        (18, None, '클로킹(구글봇)', 1, 1, 0),
        (18, None, None, 2, 2, 0),
        (20, '성인', None, 1, 1, 0),
        (20, None, '노출 광고', 1, 1, 0),
        (20, None, None, 1, 1, 0),
    ],
    'outside_hosts': [
        (0, 'win-toto.invalid', 3, False, 1),
        (1, 'bet365.invalid', 1, False, 1),
        (2, 'my-toto.invalid', 1, False, 1),
        (10, 'bet.invalid', 1, False, 2),
        (10, 'x.invalid', 1, False, 1),
        (12, 'slot-king.invalid', 1, False, 1),
        (16, 'www.youtube.com', 1, True, 1),
        (17, 'ads.invalid', 1, False, 1),
        (20, 'a.invalid', 1, False, 1),
        (20, 'b.invalid', 1, False, 2),
    ],
    'element_types': [
        (0, 'hidden', 2),
        (0, 'link', 1),
        (1, 'link', 1),
        (1, 'text', 1),
        (2, 'link', 1),
        (3, 'text', 2),
        (4, 'text', 1),
        (5, 'text', 1),
        (6, 'text', 1),
        (7, 'text', 1),
        (8, 'text', 1),
        (9, 'iframe', 1),
        (9, 'text', 2),
        (10, 'hidden', 1),
        (10, 'text', 1),
        (12, 'redirect', 1),
        (13, 'link', 1),
        (14, 'alt', 1),
        (14, 'meta', 1),
        (14, 'noscript', 1),
        (15, 'text', 1),
        (15, 'title', 1),
        (16, 'link', 1),
        (17, 'link', 1),
        (17, 'text', 1),
        (19, 'link', 1),
        (20, 'text', 2),
    ],
    'cloaked_pages': [
        (18, 'google_referer', '구글 검색 경유', '구글 검색으로 들어올 때만', 1.0, '', 'http://jump-bet.invalid/', '', '안내', '안내', '다른 사이트로 이동: http://jump-bet.invalid/'),
        (18, 'googlebot', '구글봇', '구글봇에게만', 0.4, '카지노 바카라 먹튀', '', 'casino.invalid', '카지노', '안내', '카지노'),
    ],
    'stuffed_pages': [
        (15, 32, 4, 1.0, 8, '토토사이트 카지노 바카라 먹튀', 1, '카지노 바카라'),
    ],
    'stuffing_cases': [
        (0, 30, 3, 1.0, 1, '카지노 바카라 먹튀'),
        (3, 24, 3, 0.054, 8, '카지노 바카라 먹튀'),
        (5, 24, 4, 1.0, 1, '룰렛 환전 급전 대출'),
    ],
    'unchecked_areas': [
        (0, 'iframe', 'iframe', 'http://f.kr/', '#f', 'iframe이 불러와지지 않아 내용을 확인하지 못함 (숨겨진 탭 안의 iframe 등)', 'f.kr', False, 2, '[iframe] http://f.kr/ (위치: #f) - iframe이 불러와지지 않아 내용을 확인하지 못함 (숨겨진 탭 안의 iframe 등)'),
        (0, 'iframe', 'iframe', 'http://h.kr/', '', 'too many', 'h.kr', False, 1, '[iframe] http://h.kr/ - too many'),
        (0, 'page', '페이지', 'https://www.city.go.kr/1', '', '페이지를 열지 못함: timeout', 'www.city.go.kr', True, 1, '[페이지] https://www.city.go.kr/1 · 신뢰 도메인 - 페이지를 열지 못함: timeout'),
        (0, 'page', '페이지', 'https://www.city.go.kr/2', '', '오류 페이지로 열림(HTTP 404)', 'www.city.go.kr', True, 1, '[페이지] https://www.city.go.kr/2 · 신뢰 도메인 - 오류 페이지로 열림(HTTP 404)'),
        (0, 'page', '페이지', 'https://www.city.go.kr/2', '', '일부만 검사함 (요소 9개 중 5개)', 'www.city.go.kr', True, 1, '[페이지] https://www.city.go.kr/2 · 신뢰 도메인 - 일부만 검사함 (요소 9개 중 5개)'),
        (0, 'page', '페이지', 'https://www.city.go.kr/y', '', "다른 주소와 똑같은 화면('제목 없음')이 나와 실제 내용이 점검되지 않았을 수 있음", 'www.city.go.kr', True, 1, "[페이지] https://www.city.go.kr/y · 신뢰 도메인 - 다른 주소와 똑같은 화면('제목 없음')이 나와 실제 내용이 점검되지 않았을 수 있음"),
        (0, 'page', '페이지', 'https://www.city.go.kr/z', '', "다른 주소와 똑같은 화면('제목 없음')이 나와 실제 내용이 점검되지 않았을 수 있음", 'www.city.go.kr', True, 1, "[페이지] https://www.city.go.kr/z · 신뢰 도메인 - 다른 주소와 똑같은 화면('제목 없음')이 나와 실제 내용이 점검되지 않았을 수 있음"),
        (0, 'robots', '수집 금지 주소', 'https://www.city.go.kr/secret', '', 'robots.txt에서 수집을 막아 둔 주소라 점검하지 않음', 'www.city.go.kr', True, 1, '[수집 금지 주소] https://www.city.go.kr/secret · 신뢰 도메인 - robots.txt에서 수집을 막아 둔 주소라 점검하지 않음'),
        (2, 'iframe', 'iframe', 'https://youtube.com/x', '#y', '내용을 읽지 못함 (boom)', 'youtube.com', True, 1, '[iframe] https://youtube.com/x (위치: #y) · 신뢰 도메인 - 내용을 읽지 못함 (boom)'),
        (2, 'page', '페이지', 'https://www.city.go.kr/', '', '응답이 없어 제한 시간 안에 내용을 확인하지 못함', 'www.city.go.kr', True, 1, '[페이지] https://www.city.go.kr/ · 신뢰 도메인 - 응답이 없어 제한 시간 안에 내용을 확인하지 못함'),
    ],
    'crawl_figures': [
        (0, 4, 1, 5, 1, 14, 2, 90, False, 8, '점검한 페이지: 4개 (열지 못한 페이지 1개)\n점검한 iframe: 1개\n검사한 요소: 14개\n점검하지 못한 영역: 8곳\n내용이 같은 페이지 2개(중복, 주소만 다르고 화면이 같음)\n소요 시간: 1분 30초'),
        (1, 1, 0, 1, 0, 12345, 0, 45, True, 0, '점검한 페이지: 1개\n점검한 iframe: 0개\n검사한 요소: 12,345개\n점검하지 못한 영역: 0곳\n소요 시간: 45초\n사용자가 중간에 중지함'),
        (2, 1, 0, 2, 0, 0, 0, None, False, 2, '점검한 페이지: 1개\n점검한 iframe: 0개\n검사한 요소: 0개\n점검하지 못한 영역: 2곳'),
    ],
    'gate_cases': [
        (0, False, False, False),
        (1, True, True, False),
        (2, True, False, True),
        (3, False, True, False),
        (4, True, False, False),
        (5, True, True, False),
    ],
    'cloaking_targets': [
        (0, '다른 사이트로 이동'),
        (1, '숨김 링크·자동 이동'),
        (2, '광고 키워드'),
        (3, '광고 키워드'),
        (4, ''),
        (5, '첫 페이지'),
        (6, '모든 페이지 검사'),
        (7, ''),
    ],
    'throttled_visits': [
        (0, 1, 'HTTP 429 요청이 너무 많음', 2.0, 2.0, False),
        (0, 3, 'HTTP 429 요청이 너무 많음', 4.0, 60.0, False),
        (0, 4, 'HTTP 429 요청이 너무 많음', 8.0, 8.0, False),
        (1, 1, 'HTTP 503 일시적으로 사용할 수 없음', 2.0, 7.0, False),
        (1, 2, 'HTTP 503 일시적으로 사용할 수 없음', 4.0, 4.0, False),
        (1, 3, 'HTTP 503 일시적으로 사용할 수 없음', 8.0, 60.0, True),
        (2, 2, 'HTTP 403 접근 거부가 연속 3회', 2.0, 2.0, False),
        (3, 0, '요청 제한 안내 페이지로 이동됨', 2.0, 2.0, False),
        (3, 2, '요청 제한 안내 페이지로 이동됨', 4.0, 4.0, False),
    ],
    'crawl_notes': [
        (0, ''),
        (1, '사이트가 요청을 계속 제한해(HTTP 429) 3페이지까지만 점검하고 멈췄습니다. 요청 간격(2.0초)을 늘리거나 잠시 뒤 다시 점검해 보세요.'),
        (2, '약관·안내 같은 고정 링크로만 3페이지를 점검했습니다.'),
        (3, 'sitemap.xml에 있는 주소로만 3페이지를 점검했습니다.'),
        (4, 'sitemap.xml과 약관·안내 같은 고정 링크로만 3페이지를 점검했습니다.'),
        (5, '발견한 링크가 적어 3페이지만 점검했습니다.'),
        (6, '입장 버튼을 누른 뒤에도 발견한 링크가 적어 3페이지만 점검했습니다.'),
        (7, '봇 차단으로 보입니다. 보안 안내 문구: 캡차, 봇 차단\n입장 버튼을 누른 뒤에도 발견한 링크가 적어 3페이지만 점검했습니다.'),
        (8, "시작 주소가 오류 페이지입니다(HTTP 404).\n같은 화면이 반복 점검되었습니다: '홈' 4곳"),
        (9, ''),
        (10, ''),
        (11, ''),
    ],
    'next_links': [
        (0, 'http://p{p}.kr/a', 0),
        (0, 'http://p{p}.kr/dir/b?x=1', 1),
        (0, 'http://sub.p{p}.kr/z', 7),
        (1, 'http://p{p}.kr/up', 2),
        (1, 'http://www.p{p}.kr/q', 3),
    ],
    'content_links': [
        (0, 'http://p{p}.kr/a'),
        (0, 'http://sub.p{p}.kr/z'),
        (1, 'http://p{p}.kr/up'),
        (1, 'http://www.p{p}.kr/q'),
    ],
    'planned_frontier': [
        (0, 'http://p{p}.kr/', 0, '', 1),
        (0, 'http://p{p}.kr/a', 1, 'sitemap.xml', 2),
        (0, 'http://p{p}.kr/dir/b?x=1', 2, 'http://p{p}.kr/dir/page', 4),
        (0, 'http://p{p}.kr/listed', 1, 'sitemap.xml', 3),
        (0, 'http://sub.p{p}.kr/z', 2, 'http://p{p}.kr/dir/page', 5),
        (1, 'http://p{p}.kr/', 0, '', 1),
        (1, 'http://p{p}.kr/a', 1, 'sitemap.xml', 2),
        (1, 'http://p{p}.kr/listed', 1, 'sitemap.xml', 3),
        (1, 'http://p{p}.kr/up', 2, 'http://p{p}.kr/dir/page', 4),
        (1, 'http://www.p{p}.kr/q', 2, 'http://p{p}.kr/dir/page', 5),
        (2, 'http://p{p}.kr/', 0, '', 1),
        (2, 'http://p{p}.kr/a', 1, 'sitemap.xml', 2),
        (2, 'http://p{p}.kr/listed', 1, 'sitemap.xml', 3),
    ],
    'crawl_joins': [
        (0, 1, 'http://sub.p{p}.kr/z', 'http://p{p}.kr/a=첫 글', 'http://p{p}.kr/dir/b?x=1 http://p{p}.kr/dir/page'),
        (1, 0, 'http://www.p{p}.kr/q', 'http://p{p}.kr/a=첫 글', ''),
        (2, 0, '', 'http://p{p}.kr/a=첫 글', 'http://p{p}.kr/dir/b?x=1 http://p{p}.kr/dir/page'),
    ],
    'sitemap_documents': [
        (0, 'sitemap', '', 'http://a.kr/s1.xml http://a.kr/i.xml'),
        (1, 'sitemap', 'http://a.kr/1| http://a.kr/2|', ''),
        (2, 'sitemap', 'http://a.kr/1| http://a.kr/2|', ''),
        (3, 'rss', 'http://a.kr/2|제목 http://a.kr/3|', ''),
        (4, 'atom', 'http://a.kr/4|t', ''),
        (5, '', '', ''),
        (6, '', '', ''),
        (7, '', '', ''),
        (8, '', '', ''),
    ],
    'robots_cases': [
        (0, False, 'http://a.kr/s.xml http://b.kr/t.xml'),
        (1, True, ''),
        (2, True, ''),
        (3, True, ''),
        (4, True, ''),
        (5, False, ''),
    ],
    'discovered_pages': [
        (0, 1, 'http://p{p}.kr/1', ''),
        (0, 2, 'http://p{p}.kr/2', '제목'),
        (0, 3, 'http://p{p}.kr/3', ''),
        (1, 1, 'http://p{p}.kr/1', ''),
        (1, 2, 'http://p{p}.kr/2', ''),
        (2, 1, 'http://p{p}.kr/4', 't'),
    ],
    'discovered_files': [
        (0, 'http://p{p}.kr/i.xml', 'sitemap', 'robots.txt', 0),
        (0, 'http://p{p}.kr/rss', 'rss', '자동 탐색', 1),
        (0, 'http://p{p}.kr/s1.xml', 'sitemap', 'robots.txt', 2),
        (1, 'http://p{p}.kr/sitemap.xml', 'sitemap', '자동 탐색', 2),
        (2, 'http://p{p}.kr/feed', 'atom', '자동 탐색', 1),
    ],
    'html_records': [
        (0, 0, 'hidden', 'html > body > div', '숨은 글 링크', '', '', False, False, 'display:none', 'https://www.city.go.kr/x', '', '', '', ''),
        (0, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', True, False, '', '', '', '', '', ''),
        (1, 0, 'hidden', 'html > body > div', '숨은 글 링크', '', '', False, False, 'visibility:hidden', 'https://www.city.go.kr/x', '', '', '', ''),
        (1, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', True, False, '', '', '', '', '', ''),
        (2, 0, 'hidden', 'html > body > div', '숨은 글 링크', '', '', False, False, 'opacity:0', 'https://www.city.go.kr/x', '', '', '', ''),
        (2, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', True, False, '', '', '', '', '', ''),
        (3, 0, 'hidden', 'html > body > div', '숨은 글 링크', '', '', False, False, 'clip', 'https://www.city.go.kr/x', '', '', '', ''),
        (3, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', True, False, '', '', '', '', '', ''),
        (4, 0, 'hidden', 'html > body > div', '숨은 글 링크', '', '', False, False, 'off-screen', 'https://www.city.go.kr/x', '', '', '', ''),
        (4, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', True, False, '', '', '', '', '', ''),
        (5, 0, 'hidden', 'html > body > div', '숨은 글 링크', '', '', False, False, 'zero-size', 'https://www.city.go.kr/x', '', '', '', ''),
        (5, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', True, False, '', '', '', '', '', ''),
        (6, 0, 'hidden', 'html > body > div', '숨은 글 링크', '', '', False, False, 'text-indent', 'https://www.city.go.kr/x', '', '', '', ''),
        (6, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', True, False, '', '', '', '', '', ''),
        (7, 0, 'hidden', 'html > body > div', '숨은 글 링크', '', '', False, False, 'tiny-font', 'https://www.city.go.kr/x', '', '', '', ''),
        (7, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', True, False, '', '', '', '', '', ''),
        (8, 0, 'hidden', 'html > body > div', '숨은 글 링크', '', '', False, False, 'transparent-text', 'https://www.city.go.kr/x', '', '', '', ''),
        (8, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', True, False, '', '', '', '', '', ''),
        (9, 0, 'hidden', 'html > body > div', '숨은 글 링크', '', '', False, False, 'same-color-as-background', 'https://www.city.go.kr/x', '', '', '', ''),
        (9, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', True, False, '', '', '', '', '', ''),
        (10, 0, 'hidden', 'html > body > div', '숨은 글 링크', '', '', False, False, 'same-color-as-background', 'https://www.city.go.kr/x', '', '', '', ''),
        (10, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', True, False, '', '', '', '', '', ''),
        (11, 0, 'text', 'html > body > div', '숨은 글 링크', '', '', False, False, '', '', '', '', '', ''),
        (11, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', False, False, '', '', '', '', '', ''),
        (11, 2, 'text', 'html > body > div > a', '링크', '', '', False, False, '', '', '', '', '', ''),
        (12, 0, 'text', 'html > body > div', '숨은 글 링크', '', '', False, False, '', '', '', '', '', ''),
        (12, 1, 'link', 'html > body > div > a', '링크', 'https://www.city.go.kr/x', '', False, False, '', '', '', '', '', ''),
        (12, 2, 'text', 'html > body > div > a', '링크', '', '', False, False, '', '', '', '', '', ''),
        (13, 0, 'hidden', 'html > body > div', 'a bc d', '', '', False, False, 'display:none', '', '', '', '', ''),
        (13, 1, 'iframe', 'html > body > div > iframe', '', '', 'https://www.city.go.kr/board/f.html', True, False, 'inside-hidden-element', '', '', '', '', ''),
        (14, 0, 'redirect', 'html > head > meta:nth-of-type(1)', '0; url=http://x.kr/', '', '', False, False, '', '', '', '', '', ''),
        (14, 1, 'meta', 'meta[name="description"]', '설명 글', '', '', False, False, '', '', 'description', '', '', ''),
        (14, 2, 'meta', 'meta[property="og:title"]', '제목', '', '', False, False, '', '', 'og:title', '', '', ''),
        (15, 0, 'link', 'html > body > ul > li:nth-of-type(1) > a', '가 나', 'https://www.city.go.kr/a?x=1#y', '', False, False, '', '', '', '', '', ''),
        (15, 1, 'link', 'html > body > ul > li:nth-of-type(2) > a', '그림', 'https://www.city.go.kr/board/list', '', False, False, '', '', '', '', '', ''),
        (15, 2, 'alt', 'html > body > img', '대체 글', '', 'https://www.city.go.kr/k.png', False, False, '', '', '', '', '', ''),
        (15, 3, 'iframe', 'html > body > iframe', 't', '', 'https://f.kr/', True, False, 'tiny-size', '', '', '', '', ''),
        (16, 0, 'link', 'html > body > button', '이동', 'https://www.city.go.kr/go', '', False, False, '', '', '', 'onclick', '', ''),
        (16, 1, 'text', 'html > body > button', '이동', '', '', False, False, '', '', '', '', '', ''),
        (16, 2, 'link', 'html > body > div', '상자', 'https://www.city.go.kr/d', '', False, False, '', '', '', 'data-href', '', ''),
        (16, 3, 'text', 'html > body > div', '상자', '', '', False, False, '', '', '', '', '', ''),
        (16, 4, 'link', 'html > body > footer > a', '끝', 'https://www.city.go.kr/f', '', False, True, '', '', '', '', '', ''),
        (17, 0, 'noscript', 'html > head > noscript', '광고 x', '', '', False, False, '', 'http://x.kr/', '', '', '', ''),
        (17, 1, 'text', 'html > body > article > h2', '글 제목', '', '', False, False, '', '', '', '', '글 제목', ''),
        (17, 2, 'text', 'html > body > article > p', '본문 글', '', '', False, False, '', '', '', '', '글 제목', ''),
        (18, 0, 'text', 'html > body > div > h3', '인기 검색어', '', '', False, False, '', '', '', '', '', '인기 검색어'),
        (18, 1, 'link', 'html > body > div > ul > li:nth-of-type(1) > a', '하나', 'https://www.city.go.kr/1', '', False, False, '', '', '', '', '', '인기 검색어'),
        (18, 2, 'text', 'html > body > div > ul > li:nth-of-type(1) > a', '하나', '', '', False, False, '', '', '', '', '', '인기 검색어'),
        (18, 3, 'link', 'html > body > div > ul > li:nth-of-type(2) > a', '둘', 'https://www.city.go.kr/2', '', False, False, '', '', '', '', '', '인기 검색어'),
        (19, 0, 'text', '#a > p:nth-of-type(1)', '하나', '', '', False, False, '', '', '', '', '', ''),
        (19, 1, 'text', '#a > p:nth-of-type(2)', '둘둘 셋', '', '', False, False, '', '', '', '', '', ''),
        (19, 2, 'text', 'html > body > div:nth-of-type(3)', '넷 다섯', '', '', False, False, '', '', '', '', '', ''),
        (20, 0, 'text', 'html > body > table > tr > td:nth-of-type(1)', '가나', '', '', False, False, '', '', '', '', '', ''),
        (20, 1, 'text', 'html > body > table > tr > td:nth-of-type(2)', '다라', '', '', False, False, '', '', '', '', '', ''),
        (21, 0, 'text', 'html > body > p', 'a b', '', '', False, False, '', '', '', '', '', ''),
        (21, 1, 'text', 'html > body > div', 'cd', '', '', False, False, '', '', '', '', '', ''),
    ],
    'html_texts': [
        (0, '', ''),
        (1, '', '숨은 글 링크'),
        (2, '', '숨은 글 링크'),
        (3, '', '숨은 글 링크'),
        (4, '', '숨은 글 링크'),
        (5, '', '숨은 글 링크'),
        (6, '', '숨은 글 링크'),
        (7, '', '숨은 글 링크'),
        (8, '', '숨은 글 링크'),
        (9, '', '숨은 글 링크'),
        (10, '', '숨은 글 링크'),
        (11, '', '숨은 글 링크'),
        (12, '', '숨은 글 링크'),
        (13, '', ''),
        (14, '', ''),
        (15, '', '가 나'),
        (16, '', '이동\n상자\n끝'),
        (17, '', '글 제목\n본문 글'),
        (18, '', '인기 검색어\n하나\n둘'),
        (19, '', '하나\n둘둘 셋\n넷 다섯'),
        (20, '', '가나다라 <!-- x'),
        (21, 'A b', 'a b\nc\nd'),
        (22, '', ''),
    ],
    'merged_records': [
        (0, 'a', 'x', 0),
        (0, 'b', 'y', 1),
        (0, 'c', 'z', 1),
        (1, 'a', 'x', 0),
        (2, 'q', 'w', 0),
    ],
    'crawl_firsts': [
        (0, 2, ''),
        (1, None, 'HTTP 500'),
        (2, 5, ''),
    ],
    'url_lists': [
        (0, 0, 'http://www.a.kr/x'),
        (0, 1, 'http://b.kr/'),
        (1, 0, 'http://c.kr/'),
        (1, 1, 'https://d.kr/'),
        (2, 0, 'http://e.kr/?a=1,2'),
        (2, 1, 'http://f.kr/'),
        (3, 0, 'http://yes.kr/'),
        (4, 0, 'http://only.kr/'),
        (6, 0, 'https://g.kr/Path?q=1'),
        (6, 1, 'http://g.kr/'),
    ],
    'streamed_findings': [
        (0, 0, 'hidden', 'div.x', 11, 'high', 'hidden'),
        (0, 1, 'hidden', 'div.x', 11, 'high', 'hidden'),
        (1, 0, 'text', '#p', 7, 'high', 'visible'),
        (2, 0, 'link', '#l', 4, 'suspect', 'visible'),
        (5, 0, 'text', '#t', 8, 'high', 'visible'),
        (6, 0, 'text', '#t', 5, 'suspect', 'reflection_surface'),
        (7, 0, 'text', '#t', 8, 'high', 'param_reflection'),
        (8, 0, 'text', '#t', 5, 'high', 'param_reflection'),
        (9, 0, 'text', '#t', 5, 'high', 'hidden'),
        (10, 0, 'hidden', '#a > b', 15, 'high', 'hidden'),
        (11, 0, 'page_redirect', '', 4, 'suspect', 'redirect'),
        (12, 0, 'redirect', 'meta', 7, 'high', 'redirect'),
        (13, 0, 'link', '#k', 5, 'high', 'search_list'),
        (14, 0, 'alt', '#i', 8, 'high', 'hidden'),
        (14, 0, 'meta', 'meta[name="keywords"]', 8, 'high', 'hidden'),
        (14, 0, 'noscript', '#n', 8, 'high', 'hidden'),
        (15, 0, 'page_stuffing', '', 7, 'high', 'stuffing'),
        (17, 0, 'link', '#s1', 6, 'high', 'hidden'),
        (18, 0, 'cloaking', '[구글 검색 경유]', 6, 'high', 'cloaking'),
        (18, 0, 'cloaking', '[구글봇]', 17, 'high', 'cloaking'),
        (20, 0, 'text', '#v', 6, 'high', 'visible'),
    ],
}
