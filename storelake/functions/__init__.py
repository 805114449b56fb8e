"""storelake.functions"""
