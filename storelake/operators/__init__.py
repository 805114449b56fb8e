"""storelake.operators"""
