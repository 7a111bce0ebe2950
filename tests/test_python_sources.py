"""Python facts and what they mean over files."""

import pytest
from graphmill.operators import python_code as Y
from graphmill.sources import python

FILES = {
    "main.py": '''
from fastapi import FastAPI
import requests as rq
from app.routers import users, items as things
from app.tasks import send_mail
app = FastAPI()
app.include_router(users.router, prefix="/v1")
app.include_router(things.router)
@app.get("/health")
def health():
    """@app.get("/not")"""
    r = rq.get(f"http://other/api/{health}/x")
    rq.request("DELETE", "http://other/" + str(r))
    send_mail.delay(1)
    helper(users.list_users())
    return r
def helper(x): return x
@app.api_route("/many", methods=["get", "POST"])
async def many(): pass
''',
    "app/__init__.py": "",
    "app/routers/__init__.py": "",
    "app/routers/users.py": '''
from fastapi import APIRouter
import httpx
from . import deep
from .items import ItemController
router = APIRouter(prefix="/users")
router.include_router(deep.inner, prefix="/deep")
@router.get("")
def list_users(): return ItemController().list_items()
@router.post("/{user_id}")
async def create_user(name: str):
    await httpx.post("http://auth/validate", json={})
    async with session.get("/rel") as r: pass
''',
    "app/routers/deep.py": '''
from fastapi import APIRouter
inner = APIRouter()
other = APIRouter(prefix="/loose")
@inner.delete("/x")
def x(): pass
@other.get("/y")
def y(): pass
''',
    "app/routers/items.py": '''
from fastapi import APIRouter
router = APIRouter()
class Base:
    def shared(self): pass
class ItemController(Base):
    def __init__(self): self.n = 1
    @router.get("/items")
    def list_items(self):
        self.shared()
        return self.own()
    def own(self): pass
''',
    "app/tasks.py": '''
from celery import Celery, shared_task
from kafka import KafkaProducer
celery_app = Celery("x")
@celery_app.task(name="mail.send")
def send_mail(i): producer.send("mails", b"x")
@shared_task
def sweep(): celery_app.send_task("mail.send", args=[1])
@staticmethod
def nothing(): pass
''',
    "flaskapp.py": '''
from flask import Flask, Blueprint
app = Flask(__name__)
bp = Blueprint("bp", __name__, url_prefix="/bp")
app.register_blueprint(bp)
@app.route("/")
def index(): pass
@bp.route("/contact", methods=["GET", "POST"])
def contact(): pass
class UserViews:
    @app.route("/profile")
    def profile(self): pass
''',
    "project/urls.py": '''
from django.urls import path, include
urlpatterns = [path("api/", include("myapp.urls")), path("ping/", ping)]
''',
    "myapp/urls.py": r'''
from django.urls import path, re_path, include
from rest_framework.routers import DefaultRouter
from . import views
from .views import OrderView, BookSet
router = DefaultRouter()
router.register("books", BookSet)
urlpatterns = [path("users/", views.user_list), path("users/<int:user_id>/", views.user_detail), path("orders/", OrderView.as_view()), re_path(r"^y/(?P<year>[0-9]{4})/$", views.user_list), path("in/", include("project.urls"))]
''',
    "myapp/views.py": '''
from django.views import View
def user_list(request): pass
def user_detail(request, user_id): pass
class OrderView(View):
    def get(self, request): pass
    def post(self, request): pass
    def helper(self): pass
class BookSet:
    def list(self, request): pass
    def destroy(self, request, pk): pass
''',
    "broken.py": "def f(:\n",
    "null.py": None,
}


@pytest.fixture(scope="module")
def facts(spark):
    return python.python_facts(spark.createDataFrame(list(FILES.items()), "path string, text string").repartition(4)).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_routes(facts):
    assert rows(Y.decorated_routes(facts), "function", "method", "path", "framework") == sorted([
        ("health", "GET", "/health", "fastapi"), ("many", "GET", "/many", "fastapi"), ("many", "POST", "/many", "fastapi"), ("list_users", "GET", "/v1/users/", "fastapi"), ("create_user", "POST", "/v1/users/{user_id}", "fastapi"),
        ("x", "DELETE", "/v1/users/deep/x", "fastapi"), ("y", "GET", "/loose/y", "fastapi"), ("ItemController.list_items", "GET", "/items", "fastapi"),
        ("index", "GET", "/", "flask"), ("contact", "GET", "/bp/contact", "flask"), ("contact", "POST", "/bp/contact", "flask"), ("UserViews.profile", "GET", "/profile", "flask"),
    ])


def test_django(facts):
    """project.urls and myapp.urls include each other: both are roots of nothing, so neither has a whole path; see the acyclic case below."""
    acyclic = facts.where("not (module = 'myapp.urls' and array_contains(values, '1=include(project.urls)'))")
    assert rows(Y.django_routes(acyclic), "view", "method", "path") == sorted([
        ("project.urls.ping", "GET", "/ping/"), ("myapp.views.user_list", "GET", "/api/users/"), ("myapp.views.user_detail", "GET", "/api/users/{user_id}/"), ("myapp.views.OrderView", "GET", "/api/orders/"),
        ("myapp.views.OrderView", "POST", "/api/orders/"), ("myapp.views.user_list", "GET", "/api/y/{year}/"), ("myapp.views.BookSet", "GET", "/api/books"), ("myapp.views.BookSet", "DELETE", "/api/books/{pk}"),
    ])
    assert rows(Y.django_routes(facts), "path") == []


def test_tasks_and_calls(facts):
    assert rows(Y.celery_tasks(facts), "function", "task") == [("send_mail", "mail.send"), ("sweep", "app.tasks.sweep")]
    assert rows(Y.http_calls(facts), "function", "method", "url") == sorted([("health", "GET", "http://other/api/{}/x"), ("health", "DELETE", "http://other/{}"), ("create_user", "POST", "http://auth/validate"), ("create_user", "GET", "/rel")])
    assert rows(Y.queue_calls(facts), "function", "library", "topic") == [("send_mail", "kafka", "mails"), ("sweep", "celery", "mail.send")]
    i = "app.routers.items."
    assert rows(Y.python_calls(facts), "src", "dst") == sorted([
        ("main.health", "main.helper"), ("main.health", "app.routers.users.list_users"), ("app.routers.users.list_users", f"{i}ItemController.__init__"),
        (f"{i}ItemController.list_items", f"{i}Base.shared"), (f"{i}ItemController.list_items", f"{i}ItemController.own"),
    ])


def test_empty(spark):
    none = python.python_facts(spark.createDataFrame([("a.py", ""), ("b.py", None), ("c.py", "x = (")], "path string, text string"))
    assert none.count() == Y.decorated_routes(none).count() == Y.django_routes(none).count() == Y.python_calls(none).count() == 0
