"""Frontend facts and what they mean over files."""

import pytest
from graphmill.operators import frontend_code as E
from graphmill.sources import frontend

FILES = {
    "src/utils/request.ts": "export default axios.create({})",
    "src/api/users.ts": '''
import request, { helper as h2 } from '@/utils/request'
import './side.css'
export const listAll = () => request.get('/v2/users')
export function remove(id: number): Promise<void> { return request.delete(`/users/${id ? `${a}` : "}"}/x`) }
const re = /request.get('no')/g; // request.get('/no')
/* fetch('/no') */
export async function save(dto) {
  await fetch('/api/save', { method: 'POST', body: JSON.stringify(dto) })
}
export const far = (x) => { inner(x) }
function inner(x) { request.post<User[]>("/a/" + x.id + "/b", {}) }
if (a < b && c > (d)) { ignore() }
''',
    "src/stores/users.js": "import * as api from '../api/users'\nexport const load = async () => { await api.listAll(); api.far(1) }\nexport default function () {}",
    "src/views/UserList.vue": "<template><b>request.get('/no')</b></template>\n<script setup lang=\"ts\">\nimport { load } from '@/stores/users'\nimport { remove as del } from '../api/users.ts'\nonMounted(() => { load() })\nfunction drop(u) { del(u.id) }\n</script>",
    "src/views/Health.vue": "<script>\nexport default { methods: { ping() { this.go() }, go() { fetch('/api/health').then(r => r.json()) } } }\n</script>\n<script>request.put(`/p`)</script>",
    "src/router/index.ts": '''
import Detail from '@/views/Detail.vue'
const routes = [
  { path: '/users', name: 'Users', component: () => import('@/views/UserList.vue') },
  { path: '/d/:id', component: Detail, children: [{ path: 'sub', component: () => import(`./Sub.vue`) }] },
  { path: '/none' },
]''',
    "src/other.ts": "const routes = [{ path: '/not-a-router', component: () => import('@/views/X.vue') }]",
    "null.ts": None,
    "empty.vue": "<template/>",
}


@pytest.fixture(scope="module")
def facts(spark):
    return frontend.frontend_facts(spark.createDataFrame(list(FILES.items()), "path string, text string").repartition(3)).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_clients(facts):
    u = "src/api/users.ts"
    assert rows(E.api_clients(facts).na.fill("-"), "path", "function", "method", "url", "component") == sorted([
        (u, "listAll", "GET", "/v2/users", "-"), (u, "remove", "DELETE", '/users/${id ? `${a}` : "}"}/x', "-"), (u, "save", "POST", "/api/save", "-"), (u, "inner", "POST", "/a/${}/b", "-"),
        ("src/views/Health.vue", "go", "GET", "/api/health", "Health"), ("src/views/Health.vue", "", "PUT", "/p", "Health"),
    ])


def test_routes(facts):
    assert rows(E.frontend_routes(facts), "path", "component") == [("/d/:id", "Detail"), ("/users", "UserList"), ("sub", "Sub")]


def test_components(facts):
    assert rows(E.component_clients(facts), "component", "method", "url") == sorted([
        ("UserList", "GET", "/v2/users"), ("UserList", "POST", "/a/${}/b"), ("UserList", "DELETE", '/users/${id ? `${a}` : "}"}/x'), ("Health", "GET", "/api/health"), ("Health", "PUT", "/p"),
    ])
    assert ("src/api/users#far", "src/api/users#inner") in rows(E.function_calls(facts), "src", "dst")


def test_broken_and_empty(spark):
    text = FILES["src/api/users.ts"] + FILES["src/router/index.ts"]
    cut = frontend.frontend_facts(spark.createDataFrame([(f"{k}.ts", text[:k]) for k in range(0, len(text), 5)], "path string, text string").repartition(2))
    assert cut.where("kind = 'function' and name = 'listAll'").count() > 100
    none = frontend.frontend_facts(spark.createDataFrame([("a.vue", "<script>"), ("b.ts", "")], "path string, text string"))
    assert none.count() == E.component_clients(none).count() == E.frontend_routes(none).count() == 0


def test_paths():
    assert frontend.resolved("web/src/views/a/B.vue", "@/api/x.ts") == "web/src/api/x"
    assert frontend.resolved("src/views/B.vue", "../api") == "src/api" and frontend.resolved("src/a.ts", "./b/index.js") == "src/b" and frontend.resolved("a.ts", "vue") == "vue"
