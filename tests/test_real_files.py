"""Evaluators on files as people write them, in four languages, against counts made by hand."""

import pytest
from govlens.operators.evaluators import EVALUATORS, measure

CSHARP = '''using System;
using Microsoft.Extensions.Logging;

namespace Shop.Orders;

/// <summary>Reads and writes orders.</summary>
public sealed class OrderRepository : IOrderRepository
{
    private readonly HttpClient _client;
    private readonly ILogger<OrderRepository> _logger;
    private static int _count = 0;

    public int Total { get; private set; }

    /// <summary>Finds one order.</summary>
    public async Task<Order?> FindAsync(int id, CancellationToken token)
    {
        if (id <= 0 || token.IsCancellationRequested)
        {
            return null; // nothing to find
        }

        try
        {
            var found = await _client.GetAsync(id);
            _logger.LogInformation("found {Id}", id);
            return found;
        }
        catch (HttpRequestException e)
        {
            _logger.LogError(e, "failed");
            throw;
        }
        catch (Exception)
        {
        }

        Thread.Sleep(10);
        return null;
    }

    protected virtual void Save(Order order)
    {
        // TODO: batches
        foreach (var line in order.Lines)
            Total += line.Price;
    }
}
'''
JAVA = '''package shop.orders;

import java.util.List;

/** Talks to the payment service. */
public class PaymentFacade {
    private final PaymentService service;
    private final Logger logger;
    private static volatile PaymentFacade instance;
    private String apiKey = "abc123";

    private PaymentFacade() { }

    public static synchronized PaymentFacade getInstance() {
        if (instance == null) {
            instance = new PaymentFacade();
        }
        return instance;
    }

    @Transactional
    public void pay(List<Order> orders) {
        for (Order o : orders) {
            try {
                service.charge(o);
                logger.info("paid {}", o.id());
            } catch (final Exception e) {
            }
        }
        MessageDigest.getInstance("MD5");
    }
}
'''
PYTHON = '''import logging
import hashlib

logger = logging.getLogger(__name__)


class ReportBuilder:
    """Builds reports."""

    def __init__(self, source):
        self.source = source
        self.parts = []

    def with_part(self, part):
        self.parts.append(part)
        return self

    def build(self):
        # FIXME slow
        for part in self.parts:
            if part.empty and not self.source:
                continue
            try:
                self.render(part)
            except ValueError:
                pass
            except Exception as e:
                logger.warning("no part %s", e)
        return hashlib.md5(b"x").hexdigest()
'''
TYPESCRIPT = '''import { Component, OnDestroy } from "@angular/core";

export class FeedComponent implements OnDestroy {
    private readonly feed: FeedService;

    constructor(private readonly mediator: Mediator) {}

    public async load(id: string): Promise<void> {
        this.feed.items.subscribe(x => this.show(x));
        await this.mediator.send(new LoadFeed(id));
        if (id && this.open) {
            this.bus.publish(id);
        }
    }

    ngOnDestroy() {
        this.subscription.unsubscribe();
    }
}
'''
FILES = [("o.cs", CSHARP), ("p.java", JAVA), ("r.py", PYTHON), ("f.ts", TYPESCRIPT)]
EXPECTED = [
    ("complexity", "o.cs", {"decisions": 5, "methods": 2}),  # if, ||, two catches, foreach
    ("complexity", "p.java", {"decisions": 3, "methods": 2}),  # if, for, catch
    ("complexity", "r.py", {"decisions": 4, "methods": 3}),  # for, if, two excepts
    ("cohesion", "o.cs", {"fields": 3, "methods": 2}),
    ("cohesion", "p.java", {"fields": 4, "methods": 2}),
    ("maintainability", "o.cs", {"lines": CSHARP.count("\n"), "comments": 4}),
    ("error_handling", "o.cs", {"catches": 2, "empty": 1, "generic": 1}),
    ("error_handling", "p.java", {"catches": 1, "empty": 1, "generic": 1}),
    ("error_handling", "r.py", {"catches": 2, "empty": 1, "generic": 1}),
    ("god_class", "o.cs", {"properties": 1}),
    ("repository_pattern", "o.cs", {"interface": 1, "asyncs": 1, "external": 1, "fields": 3}),
    ("logging", "o.cs", {"calls": 2, "structured": 1, "levelled": 2, "noisy": 0}),
    ("logging", "p.java", {"calls": 1, "structured": 1, "levelled": 1}),
    ("logging", "r.py", {"calls": 1, "structured": 1, "levelled": 1}),
    ("performance", "o.cs", {"blocking": 1, "asyncs": 1, "loops": 1}),
    ("architectural_security", "p.java", {"secrets": 1, "weak_crypto": 1}),
    ("architectural_security", "r.py", {"secrets": 0, "weak_crypto": 1}),
    ("documentation", "o.cs", {"declarations": 2, "documented": 2}),
    ("facade", "p.java", {"dependencies": 2, "public_methods": 2}),
    ("builder", "r.py", {"builds": 1, "fluent": 1, "mutations": 2}),
    ("observer", "f.ts", {"publishes": 1, "subscribes": 1, "released": 2}),
    ("mediator", "f.ts", {"sends": 1}),
    ("repository_hygiene", "r.py", {"todos": 1}),
    ("repository_hygiene", "o.cs", {"todos": 1}),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, "m", t) for p, t in FILES], "path string, module string, text string").cache()


@pytest.mark.parametrize("name,path,counts", EXPECTED)
def test_counts(files, name, path, counts):
    found = {r.path: r for r in measure(files, EVALUATORS[name]).collect()}
    assert path in found and {k: found[path][k] for k in counts} == counts
